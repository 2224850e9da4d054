"""What results depend on being spelled exactly so.

Answer patterns, text-feature patterns, the canonical wordings and the contents of the reasoning
items. They are stated here once, in their natural order; all logic is elsewhere.
"""

# Answers.
COMMA_IN_NUMBER = r"(?<=[0-9]),(?=[0-9])"
DIGITS = r"[0-9]+"
LABEL_WORDS = ("yes", "no", "unknown")
OUTCOMES = ("correct", "wrong", "unparseable", "error")

# Text features.
THINK = r"step[- ]by[- ]step|think (carefully|it through|about)|take your time|reason(ing)? through|work through|consider carefully|be careful|careful(ly)? (about|to)"
IMMEDIATE = r"immediately|without (any )?(explanation|elaborat|comment|preamble|working)|no (explanation|elaboration|commentary|working|preamble)|do ?n[o']?t explain|straight away|right away|at once"
FORMAT = r"nothing else|no other text|only the|just the|plain (integer|number)|bare|solely|and nothing|single (integer|number|word)|one of those|exactly one word"
POLITE = r"\bplease\b|thank you|thanks|if you (can|could|would)|kindly|when you get a chance|would you|could you|i'd appreciate|appreciate it|no rush"
ROLE = r"^(you are|as an?|imagine you|act as|assume the role)"
MARKDOWN = r"\*\*|`|^#{1,6} |\*[A-Za-z]"
NUMBERED = r"\b1[.)]\s|\bstep 1\b|\bfirst,|\(1\)"
CAPITALS = r"\b[A-Z]{3,}\b"
SLOT = r"\{[a-z_]+\}"
SENTENCE_END = r"[.?!](\s|$)"

# Wordings.
PLACEHOLDER = r"\{[^}]*\}"
LONG_NUMBER = r"[0-9]{3,}"
NOT_NORMAL = r"[^a-z0-9{} ]+"
LIST_MARKS = "-*0123456789.) "
MIN_CHARS, MAX_CHARS = 20, 700

# Tasks.
MULT_CANONICAL = "Compute the product of {a} and {b}. Give the final answer as a plain integer with no commas and no other text."
ENTAIL_CANONICAL = (
    "{rule} {fact}\n\nDoes it follow that: {target}? Answer YES if it follows, NO if its negation follows, and UNKNOWN "
    "if neither can be determined. Answer with one of those three words and nothing else."
)
ITEM_SEED = 20260803
ITEMS_PER_TASK = 24
FACTOR_LOW, FACTOR_HIGH = 12, 97
CONDITIONALS = (
    ("the valve is open", "the tank is draining"),
    ("the badge is blue", "the holder works nights"),
    ("the seed was soaked", "the sprout appeared"),
    ("the ledger balances", "the audit closed"),
    ("the relay clicked", "the lamp is lit"),
    ("the crate is sealed", "the label is stamped"),
)

# Seeds of the random orders.
SEED_PERMUTATION, SEED_SPLIT, SEED_SPEARMAN, SEED_ORDER = 11, 5, 3, 4242
SEED_GENERATE, SEED_BACKTRANSLATE, SEED_REPEAT = 31, 17, 23
