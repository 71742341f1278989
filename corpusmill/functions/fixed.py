"""Word lists, patterns, weights, ratios, prompts and answer keys.

Everything in this file is data that has to equal the published behaviour for results to agree.
"""

# --- white space as Python's str.split() and str.strip() see it (body of a regex class) -----------
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: English stop words (those that are alphanumeric) --------------------------------
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

# --- fixed values: quality scorer ------------------------------------------------------------------
DIMENSION_WEIGHTS = {
    "clarity": 0.25,
    "response_quality": 0.35,
    "diversity": 0.20,
    "complexity": 0.20,
}
INSTRUCTION_PATTERNS = [
    r"^(write|create|generate|compose)\s+",
    r"^(explain|describe|define|clarify)\s+",
    r"^(list|enumerate|name|provide)\s+",
    r"^(analyze|evaluate|compare|contrast)\s+",
    r"^(solve|calculate|compute|determine)\s+",
    r"^(translate|convert|transform|change)\s+",
    r"^(summarize|outline|brief|condense)\s+",
    r"^(what|why|how|when|where|who)\s+",
    r"(step[s]?\s+by\s+step|detailed|specific)",
    r"(example[s]?|instance[s]?|illustration[s]?)",
]
VAGUE_WORDS = ["something", "stuff", "thing", "whatever", "somehow"]
COMMON_TOPICS = [
    "python", "code", "programming", "function", "def",
    "explain", "write", "create", "list", "what",
    "machine learning", "ai", "data", "algorithm",
]
TEMPLATE_PATTERNS = [
    r"^here (is|are)",
    r"^this (is|are)",
    r"^the \w+ (is|are)",
    r"^\d+\.",
    r"^step \d+:",
    r"^first,.*second,.*third",
]
COMPLEX_INDICATORS = [
    "analyze", "evaluate", "compare", "contrast", "synthesize",
    "critique", "design", "develop", "formulate", "investigate",
    "why", "how", "explain the relationship", "what if",
]
STEP_INDICATORS = [
    "first", "second", "third", "then", "next", "finally",
    "step 1", "step 2", "additionally", "furthermore", "moreover",
    "because", "therefore", "thus", "consequently", "as a result",
]
# The text is lowercased before the test, so "O(" never matches; it is kept as published.
TECHNICAL_INDICATORS = [
    "```", "def ", "function", "class ", "import ",
    "algorithm", "complexity", "O(", "equation", "formula",
    "theorem", "hypothesis", "variable", "parameter",
]
KNOWLEDGE_INDICATORS = [
    "research", "studies", "evidence", "theory", "principle",
    "law of", "according to", "based on", "demonstrates", "indicates",
]
CLAUSE_WORDS = ["which", "that", "who", "whom", "whose", "where", "when"]

# --- fixed values: tiers, bins, histograms ---------------------------------------------------------
TIER_SIZES = {"ultra_high_10k": 10_000, "high_100k": 100_000, "medium_1m": 1_000_000}
SUMMARY_PERCENTILES = [25, 50, 75, 90, 95, 99]
LENGTH_EDGES = [0, 256, 512, 1024, 2048, 4096, 8192]

# --- fixed values: mixing strategies ---------------------------------------------------------------
MIX_SOURCES = ["openhermes", "cosmopedia", "magpie", "fineweb"]
MIX_STRATEGIES = {
    "equal_mix": {"openhermes": 0.25, "cosmopedia": 0.25, "magpie": 0.25, "fineweb": 0.25},
    "instruction_heavy": {"openhermes": 0.40, "cosmopedia": 0.20, "magpie": 0.30, "fineweb": 0.10},
    "knowledge_heavy": {"openhermes": 0.20, "cosmopedia": 0.40, "magpie": 0.10, "fineweb": 0.30},
    "conversation_heavy": {"openhermes": 0.20, "cosmopedia": 0.10, "magpie": 0.50, "fineweb": 0.20},
    "quality_weighted": {"openhermes": 0.35, "cosmopedia": 0.25, "magpie": 0.30, "fineweb": 0.10},
    "capability_balanced": {"openhermes": 0.30, "cosmopedia": 0.25, "magpie": 0.25, "fineweb": 0.20},
}

# --- fixed values: output prompts with the elements a good answer mentions -------------------------
ANALYSIS_PROMPTS = [
    ("instruction", "Write a Python function that checks if a number is prime.",
     ["def", "prime", "return", "for", "if"], 200),
    ("instruction", "List three benefits of regular exercise.",
     ["health", "improve", "reduce", "benefit"], 150),
    ("reasoning", "If it takes 5 machines 5 minutes to make 5 widgets, how long does it take 100 "
     "machines to make 100 widgets? Explain your reasoning.",
     ["5 minutes", "rate", "same", "each machine"], 150),
    ("creative", "Write a creative description of a sunset over the ocean.",
     ["sun", "ocean", "color", "sky", "water"], 200),
    ("factual", "What is photosynthesis and why is it important?",
     ["plants", "light", "oxygen", "carbon dioxide", "energy"], 150),
    ("complex", "Create a step-by-step plan for learning a new programming language, including "
     "resources and milestones.",
     ["step", "learn", "practice", "project", "resource"], 250),
]
SAMPLE_PROMPTS = [
    ("instruction", "Write a Python function to calculate the factorial of a number.", 200),
    ("instruction", "Explain photosynthesis in simple terms suitable for a 10-year-old.", 150),
    ("instruction", "List 5 tips for improving sleep quality.", 200),
    ("creative", "Write a short story about a robot learning to paint.", 300),
    ("creative", "Compose a haiku about artificial intelligence.", 50),
    ("qa", "What are the main differences between machine learning and deep learning?", 200),
    ("qa", "Why is the sky blue?", 150),
    ("reasoning", "If all roses are flowers and some flowers fade quickly, can we conclude that "
     "some roses fade quickly? Explain your reasoning.", 150),
    ("reasoning", "A farmer has 17 sheep. All but 9 die. How many are left? Explain step by step.", 100),
    ("summarization", "Summarize the key points of climate change in 3 bullet points.", 150),
    ("code", "Write a JavaScript function to reverse a string without using the built-in reverse "
     "method.", 150),
    ("math", "Solve this equation step by step: 2x + 5 = 13", 100),
]
PROMPT_FRAME = "### Instruction:\n{}\n\n### Response:\n"

# --- fixed values: answer keys (task type, prompt, rule, tokens, k) --------------------------------
ANSWER_KEYS = [
    ("instruction_following", "List three colors.", "at_least",
     ["red", "blue", "green", "yellow", "purple", "orange", "black", "white"], 3),
    ("instruction_following", "Write a greeting.", "any", ["hello", "hi", "greetings", "welcome"], 1),
    ("instruction_following", "Count from 1 to 5.", "all", ["1", "2", "3", "4", "5"], 5),
    ("factual_knowledge", "What is the capital of France?", "any", ["paris"], 1),
    ("factual_knowledge", "How many days are in a week?", "any", ["7", "seven"], 1),
    ("factual_knowledge", "What planet do we live on?", "any", ["earth"], 1),
    ("text_completion", "The sun rises in the", "any", ["east"], 1),
    ("text_completion", "Water freezes at 0 degrees", "any", ["celsius", "centigrade", "c"], 1),
]
FEW_SHOT_KEYS = [
    ("simple_qa", "Q: What is the capital of France?\nA:", "any", ["paris"], 1),
    ("arithmetic", "Q: What is 15 + 27?\nA:", "any", ["42"], 1),
    ("completion", "The quick brown fox", "any", ["jumps", "jumped"], 1),
]
# Capability suites; "count" asks for k occurrences of one of the tokens, "_cs" tests keep the case.
CAPABILITY_KEYS = [
    ("instruction_following", "Write a Python function to calculate factorial.", "all_cs",
     ["def", "factorial"], 2),
    ("instruction_following", "List 5 tips for better sleep.", "count", ["\n", "•"], 4),
    ("instruction_following", "Explain photosynthesis in simple terms.", "all", ["light", "plant"], 2),
    ("factual_knowledge", "What is the capital of France?", "any", ["paris"], 1),
    ("factual_knowledge", "When did World War II end?", "any", ["1945"], 1),
    ("factual_knowledge", "What is the speed of light?", "any", ["299", "300", "3×10"], 1),
    ("reasoning", "If all roses are flowers and some flowers fade quickly, can we conclude that some "
     "roses fade quickly?", "any", ["no", "cannot"], 1),
    ("reasoning", "I have 3 apples. I eat 1 and buy 2 more. How many do I have?", "any", ["4"], 1),
]

# --- fixed values: composite weights ---------------------------------------------------------------
MODEL_WEIGHTS = {"quality_score": 0.4, "task_performance": 0.4, "diversity_score": 0.2}
DEFAULT_FAMILY_WEIGHT = 0.25

# --- fixed values: English stemmer (suffixes in the order in which they are tried) -------------------
STEM_IRREGULAR = {
    "sky": "sky skies",
    "die": "dying",
    "lie": "lying",
    "tie": "tying",
    "news": "news",
    "inning": "innings inning",
    "outing": "outings outing",
    "canning": "cannings canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}
STEM_PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEM_DOUBLE_SUFFIXES = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
]
STEM_SUFFIXES = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEM_LAST_SUFFIXES = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
