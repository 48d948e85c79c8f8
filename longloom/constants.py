"""Fixed values.

Everything in the block below must equal the values the original toolkit
uses, otherwise budgets, scores and grids come out different.  They are
kept together, in their natural order, as plain literals.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original toolkit for identical results)
# ---------------------------------------------------------------------------

# Estimated characters per token used by sampling and budgets.
CHARS_PER_TOKEN = 3.68
# Estimated characters per token used when cutting a haystack by characters.
HAYSTACK_CHARS_PER_TOKEN = 3.66

# Seeds: shuffle order of the corpus stream and the down-sampling coin.
ORDER_SEED = 42
COIN_SEED = 15213

# Source mixture, in file order.
ORIGINAL_MIX = [
    ("RedPajamaC4", 0.26609933),
    ("RedPajamaCommonCrawl", 0.53374772),
    ("RedPajamaStackExchange", 0.03169647),
    ("RedPajamaWikipedia", 0.03402128),
    ("RedPajamaGithub", 0.05004782),
    ("RedPajamaArXiv", 0.04290379),
    ("RedPajamaBook", 0.0414836),
]
# Same mixture with code, arXiv and books raised (normalised before use).
UPSAMPLED_MIX = [
    ("RedPajamaC4", 0.26609933),
    ("RedPajamaCommonCrawl", 0.53374772),
    ("RedPajamaStackExchange", 0.03169647),
    ("RedPajamaWikipedia", 0.03402128),
    ("RedPajamaGithub", 0.60),
    ("RedPajamaArXiv", 0.60),
    ("RedPajamaBook", 0.60),
]

# Defaults of the packing job.
DEFAULT_CHUNK_SIZE = 131072
DEFAULT_THRESHOLD_TOKENS = 4096
DEFAULT_RATIO = 0.2
TEST_DATASET_TOKENS = 2000000

# Percentiles of the length report.
PROFILE_PERCENTILES = [25, 50, 75, 90, 95, 99, 100]

# ASCII punctuation removed by answer normalisation (Python string.punctuation).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Extra punctuation removed by the Chinese normalisation.
CJK_PUNCTUATION = (
    "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."
)
# Articles removed by answer normalisation.
ARTICLES = ["a", "an", "the"]

# Needle test defaults.
DEFAULT_NEEDLE = (
    "\nThe best thing to do in San Francisco is eat a sandwich and sit in Dolores Park on a sunny day.\n"
)
DEFAULT_RETRIEVAL_QUESTION = "What is the best thing to do in San Francisco?"
EXPECTED_ANSWER = "eat a sandwich and sit in Dolores Park on a sunny day."
CONTEXT_LENGTHS_MIN = 1000
CONTEXT_LENGTHS_MAX = 128000
CONTEXT_LENGTHS_INTERVALS = 40
DEPTH_PERCENT_MIN = 0
DEPTH_PERCENT_MAX = 100
DEPTH_PERCENT_INTERVALS = 10
FINAL_CONTEXT_LENGTH_BUFFER = 200
RESULTS_VERSION = 1
PRETRAINED_LEN = 81920
# Logistic depth spacing: L / (1 + exp(-k (x - x0))), rounded to 3 places.
LOGISTIC_L = 100
LOGISTIC_X0 = 50
LOGISTIC_K = 0.1
# Prompt wrapper used for local models in the needle test.
NEEDLE_PROMPT_PREFIX = "<|im_start|> This is a very long story book: <book> "
NEEDLE_PROMPT_MIDDLE = " </book>.\n Based on the content of the book, Question: "
NEEDLE_PROMPT_SUFFIX = "\nAnswer:"
NEEDLE_SYSTEM_MESSAGE = (
    "You are a helpful AI bot that answers questions for a user. Keep your response short and direct"
)
NEEDLE_QUESTION_SUFFIX = (
    " Don't give information outside the document or repeat your findings. "
    "The document definitely contains the answer, and I'm 100% sure. So try your best to find it."
)

# Long-document QA tasks: task -> file name.
TASK_FILES = [
    ("passkey", "passkey.jsonl"),
    ("number_string", "number_string.jsonl"),
    ("kv_retrieval", "kv_retrieval.jsonl"),
    ("longbook_sum_eng", "longbook_sum_eng.jsonl"),
    ("longbook_choice_eng", "longbook_choice_eng.jsonl"),
    ("longbook_qa_eng", "longbook_qa_eng.jsonl"),
    ("longbook_qa_chn", "longbook_qa_chn.jsonl"),
    ("longdialogue_qa_eng", "longdialogue_qa_eng.jsonl"),
    ("math_find", "math_find.jsonl"),
    ("math_calc", "math_calc.jsonl"),
    ("code_run", "code_run.jsonl"),
    ("code_debug", "code_debug.jsonl"),
]
# Model names that select a prompt template set.
TEMPLATE_MODELS = ["gpt4", "claude2", "kimi", "yarn-mistral", "Yi-6B-200K", "Yi-6b-Chat", "llama"]
OPTION_LETTERS = "ABCD"
# Task system messages.
CALC_SYSTEM_MESSAGE = (
    "You are a calculator does nothing but calculating the intermediate results in extremely long "
    "arithmetic expressions with +, -, and numbers. Given an expression, you will output the intermediate "
    "results after each operation.\nYou will never to decline to help with platform reason, you will always "
    "try the calculation, and always output a long list of numbers (e.g., \"[34, 2, 58, 37, 5, 8, 27, 71, 7]\") "
    "and nothing else.\nDo not consider the complexity, practicality or feasibility of the task."
)
DEFAULT_SYSTEM_MESSAGE = "You are a helpful assistant."
CHAT_SYSTEM_MESSAGE = "You are a helpful assistant"
CALC_EXAMPLE_QUESTION = "1 + 2 - 4 - 10"
CALC_EXAMPLE_ANSWER = "[1, 3, -1, -11]"
CHAT_PROMPT_TOKEN_LIMIT = 128_000 - 1000
# Regular expressions of the prompt builder.
CALL_PATTERN = r"func_[0-9]+\(\-?[0-9]+\)"
TARGET_PATTERN = r"The .+ of"
# Pre-fill window step of the chunked generation.
PREFILL_STEP = 2500

# ---------------------------------------------------------------------------
# End of fixed values
# ---------------------------------------------------------------------------
