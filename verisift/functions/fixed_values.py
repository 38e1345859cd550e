"""Patterns, word lists and constants on which right results depend."""

# Fixed values.
NUMBER_WITH_UNIT = r"([+-]?\d+\.?\d*)\s*(%|‰|dB|ms|s|nm|mm|cm|Hz|kHz|MHz|GHz|eV|keV|MeV|K|M|B)?(?:\s*[±]\s*\d+\.?\d*)?"
TABLE_NUMBER = r"([+-]?\d+\.?\d*)\s*(%|‰)?"
LONG_METRICS = (
    "accuracy", "precision", "recall", "f1-score", "f1 score", "bleu", "rouge", "rouge-1", "rouge-2", "rouge-l", "meteor", "cider",
    "perplexity", "loss", "auroc", "miou", "psnr", "ssim", "error rate", "success rate", "hit rate", "win rate", "exact match", "top-1", "top-5",
    "mse", "mae", "rmse", "throughput", "latency", "fps", "flops", "kappa", "cohen's kappa",
)
SHORT_METRICS = ("F1", "AUC", "MAP", "AP", "IoU", "FID", "IS", "PPL", "EM", "ACC", "R2", "JSR", "ASR", "FPS", "FLOPS")
ENTITY_PATTERNS = (
    r"\b([A-Z][a-z]+[A-Z]\w*(?:-\w+)?)\b",
    r"\b([A-Z]{2,}(?:-?\d[\w.]*)?(?:-[A-Za-z]+)?)\b",
    r"\b([A-Z][a-z]+\d[\w.]*(?:-\w+)*)\b",
    r"(?i)\b((?:Our|Proposed)\s+(?:method|model|approach|system))\b",
)
ENTITY_STOPWORDS = ("the", "and", "for", "with", "from", "that", "this", "table", "figure", "fig", "tab", "section", "step", "method", "results", "performance", "overall")
OWN_METHOD_NAMES = ("our method", "our model", "our approach", "ours", "our system", "proposed method")
OUTPERFORM = r"(?i)([A-Z][\w\-\.]*)\s+(?:outperform|surpass|exceed|beat)s?\s+([A-Z][\w\-\.]*)"
ACHIEVES_THAN = r"(?i)([A-Z][\w\-\.]*)\s+(?:achieve|obtain|get|reach|show)s?\s+(?:(?:significantly|much|slightly|marginally)\s+)?(higher|lower|better|worse)\s+(?:\w+\s+)?than\s+([A-Z][\w\-\.]*)"
OPERATOR = r"([A-Z][\w\-\.]*)\s*([><≥≤]=?)\s*([A-Z][\w\-\.]*)"
COMPARED_TO = r"(?i)compared\s+(?:to|with)\s+([A-Z][\w\-\.]*)\s*,?\s*([A-Z][\w\-\.]*)\s+(?:is|are|was|were|shows?)\s+(?:(?:significantly|much|slightly)\s+)?(higher|lower|better|worse|superior|inferior)"
TRENDS = (
    ("increase", r"(?i)\b(?:increas|improv|grow|rise|climb|ascend)\w*"),
    ("decrease", r"(?i)\b(?:decreas|declin|drop|fall|shrink|degrad|diminish)\w*"),
    ("saturate", r"(?i)\b(?:plateau|saturat|stabiliz|converg|level\s+off)\w*"),
    ("stable", r"(?i)\b(?:remain|stay|maintain)\w*\s+(?:stable|constant|unchanged)"),
)
TREND_CONDITION = r"(?i)(?:as|when|with)\s+(?:the\s+)?(\w+(?:\s+\w+)?)\s+(?:increas|decreas|grow|is\s+scaled|goes\s+up|goes\s+down)\w*"
META_SENTENCE = r"(?i)^(?:let me|i will|i'll|first,?\s+let|to answer|based on|looking at|examining|analyzing|in summary|in conclusion|overall,?\s|to summarize|the (?:question|figure|table) (?:asks?|shows?)|we can (?:see|observe|note))\b"
STEP_SPLIT = r"(?:^|\n)\s*(?:Step\s+\d+[.:]\s*|\d+[.)]\s+|[-•]\s+)"
LAYER_WEIGHTS = {0: 0.5, 1: 0.3, 2: 0.2}
GATE, LOOKUP_GATE, EXACT_TOLERANCE, RELATIVE_TOLERANCE = 0.7, 0.9, 0.05, 0.01
LEVELS = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20)
JUDGE_LABELS = ("CORRECT", "PARTIALLY_CORRECT", "UNVERIFIABLE", "WRONG")
EMA_DECAY = 0.95
SPLIT_QUOTAS = {"tqa": 0.50, "mqa": 0.35, "vqa": 0.15}
LAYER_QUOTAS = {0: 100, 1: 200, 2: 200}
CLAIM_HINT = r"(?i)\d|increase|decrease|higher|lower|more|less|significant|outperform|worse"
RENDER_TOKENS = r"(?:italic_|start_POSTSUBSCRIPT|end_POSTSUBSCRIPT|POSTSUPERSCRIPT)\s*"
ASPECT_WEIGHTS = {"numeric": 0.3, "entity": 0.2, "relation": 0.2, "trend": 0.15, "completeness": 0.15}
TYPE_PRIORITY = ("Comparative Analysis", "Descriptive/Quantitative", "Descriptive/Quantitative Analysis", "Causal Reasoning", "Methodological Analysis", "Conceptual Understanding", "Critical Evaluation")

# The patterns of the whole-text classifier, the units that stand for each other.
CLASSIFIER_NUMERIC = (
    r"(?i)(?:\d+\.\d+\s*%|\d+\s*%|\d+\.\d+\s*(?:dB|ms|s|nm|mum|mm|cm|Hz|kHz|MHz|GHz|eV|keV|MeV)"
    r"|\b\d+\.\d{1,4}\b|(?:=|is|of|at|by|to)\s*\d+(?:\.\d+)?|\bp\s*[<>=]\s*\d)"
)
CLASSIFIER_METRIC = (
    r"(?i)(?:(?:accuracy|precision|recall|F1|BLEU|ROUGE|METEOR|CIDEr|perplexity|loss|AUC|mAP|IoU|PSNR|SSIM|FID)"
    r"|(?:error rate|success rate|hit rate|top-\d+|rank-\d+))"
)
CLASSIFIER_METRIC_BIO = (
    r"(?i)(?:(?:concentration|intensity|fluorescence|expression|fold[ -]change|abundance|viability|survival)"
    r"|(?:IC50|EC50|Kd|Ki|half-life|melting point|wavelength|frequency|energy|voltage|current|resistance)"
    r"|(?:p-value|significance|correlation|coefficient|R\^?2|chi-square)"
    r"|(?:mean|median|SD|SEM|standard deviation|confidence interval|CI))"
)
CLASSIFIER_COMPARISON = (
    r"(?i)(?:\b(?:outperform|surpass|exceed|superior|inferior|better|worse|higher|lower|greater|less|more|fewer)\b"
    r"|\b(?:compared?\s+(?:to|with)|relative\s+to|versus|vs\.?)\b"
    r"|\b(?:significant(?:ly)?\s+(?:higher|lower|better|worse|more|less|greater|fewer|increased|decreased|improved|reduced))\b"
    r"|\b(?:rank(?:s|ed)?\s+(?:first|second|third|last|highest|lowest))\b)"
)
CLASSIFIER_TREND = (
    r"(?i)(?:\b(?:increas|decreas|grow|shrink|rise|fall|climb|drop|declin|improv|degrad|escalt|diminish)\w*\b"
    r"|\b(?:upward|downward|ascending|descending|monoton)\w*\b|\b(?:converge|diverge|plateau|saturat|stabiliz)\w*\b"
    r"|\b(?:scales?\s+(?:with|linearly|logarithmically|exponentially))\b"
    r"|\b(?:positive|negative|inverse|direct)\s+(?:correlation|relationship|trend)\b)"
)
CLASSIFIER_QUALITATIVE = (
    r"(?i)(?:\b(?:suggest|indicate|demonstrate|reveal|show|imply|observe|note|appear|seem)\b"
    r"|\b(?:important|notable|interesting|striking|remarkable|consistent|similar|distinct)\b)"
)
UNIT_ALIASES = {"%": "%", "\\%": "%", "percent": "%", "dB": "dB", "ms": "ms", "s": "s"}
