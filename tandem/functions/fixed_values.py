"""Fixed values.

Everything in this file is data that results depend on: prompt texts, chat markup, marker lists,
thresholds and limits. The values are fixed; changing one changes the output of the operators.
"""

# The 29 code points that count as white space.
WHITESPACE = "".join(map(chr, (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))

# Chat markup.
BEGIN_OF_TEXT = "<|begin_of_text|>"
HEADER_OPEN = "<|start_header_id|>"
HEADER_CLOSE = "<|end_header_id|>\n"
END_OF_TURN = "<|eot_id|>"
END_OF_TEXT = "<|end_of_text|>"
ASSISTANT_MARKER = "<|start_header_id|>assistant<|end_header_id|>"

# Prompt texts. {text} is the place of the phrase, {name} that of the assistant's name.
SYSTEM_PROMPT = (
    "Tu es un assistant expert en langue Dioula (Jula), "
    "parlée en Côte d'Ivoire et au Burkina Faso. "
    "Tu peux traduire entre le français et le Dioula, "
    "et converser naturellement dans les deux langues."
)
ASSISTANT_NAME = "Tandem"
SERVING_PROMPT = (
    "Tu es {name}, un assistant expert en langue Dioula (Jula), "
    "parlée en Côte d'Ivoire et au Burkina Faso. "
    "Tu peux traduire entre le français et le Dioula, "
    "et converser naturellement dans les deux langues. "
    "Tes réponses sont courtes, précises et naturelles."
)
FORWARD_REQUEST = "Traduis en Dioula : {text}"
REVERSE_REQUEST = "Traduis en français : {text}"
QUESTION_REQUESTS = (
    "Comment dit-on en Dioula : « {text} » ?",
    "Quelle est la traduction Dioula de : {text} ?",
    "Dis-moi en Dioula : {text}",
    "En Dioula, comment exprime-t-on : {text} ?",
)

# Language codes of corpus pairs, language names of replies, directions.
SOURCE_LANG = "fr"
TARGET_LANG = "dioula"
SOURCE_NAME = "français"
TARGET_NAME = "dioula"
FORWARD = "fr_to_dioula"
REVERSE = "dioula_to_fr"

# Substrings that mark the target language, and how many must be present.
LANGUAGE_MARKERS = (
    "ni ce", "i ni", "tɔgɔ", "bé", "kénéya", "dɛmɛ",
    "sɔrɔ", "kɔ", "fɛ", "ye", "ka", "ko", "la", "de",
)
LANGUAGE_THRESHOLD = 2

# Substrings that mark a request for a translation, and the two modes.
TRANSLATION_WORDS = ("traduis", "traduction", "translate", "comment dit-on")
MODE_TRANSLATION = "traduction"
MODE_CONVERSATION = "conversation"

# Delimiter and stop strings in the output of a generation command.
OUTPUT_DELIMITER = "=========="
OUTPUT_STOPS = (
    "<|eot_id|>", "<|end_of_text|>", "Prompt:", "Generation:", "Peak", "tokens-per-sec",
)

# Request limits and defaults.
MESSAGE_CHARS = (1, 2000)
TEXT_CHARS = (1, 1000)
MAX_TOKENS = (10, 512)
TEMPERATURE = (0.0, 1.0)
DEFAULT_MAX_TOKENS = 256
DEFAULT_TEMPERATURE = 0.3
TRANSLATE_MAX_TOKENS = 256
TRANSLATE_TEMPERATURE = 0.1

# Sampling and splitting.
SEED = 42
TRAIN_RATIO = 0.90
VALID_RATIO = 0.05
MIN_CHARS = 2
MAX_SEQ_LENGTH = 512

# Scoring thresholds and labels.
WORD_RECALL = 0.50
CHAR_RECALL = 0.60
STATUS_EXACT = "EXACT"
STATUS_PARTIAL = "PARTIEL"
STATUS_WRONG = "FAUX"
GOOD_PCT = 60
FAIR_PCT = 35
SMOKE_MIN_CHARS = 2
