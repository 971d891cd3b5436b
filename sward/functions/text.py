"""String and code expressions."""

from pyspark.sql import functions as F

# Markers that count as missing in the survey tables besides an empty field.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The one branch whose codes are two characters longer than the others.
LONG_BRANCH = "MA2"
LONG_BRANCH_EXTRA = 2

# Top groups of the class hierarchy.
TOP_GROUPS = ["MA2", "N", "Q", "R", "S", "T", "U", "V"]


def null_tokens(c, extra=()):
    """Null where the trimmed-as-is string is a missing marker."""
    return F.when(~c.isin(NULL_TOKENS + list(extra)), c)


def year_of(c):
    """Year of a recording date: drop every colon, take the last four characters."""
    return F.right(F.regexp_replace(c, ":", ""), F.lit(4)).cast("int")


def is_level(c, level):
    """True where a class code sits at hierarchy level ``level``."""
    extra = F.when(c.startswith(LONG_BRANCH), LONG_BRANCH_EXTRA).otherwise(0)
    return F.length(c) == F.lit(level) + extra


def parent_code(c, drop=1):
    """Code with its last ``drop`` characters removed."""
    return F.left(c, F.length(c) - drop)


def top_group(c):
    """Top group of a code: the long branch as a whole, else the first character."""
    return F.when(c.startswith(LONG_BRANCH), F.left(c, F.lit(3))).otherwise(F.left(c, F.lit(1)))


def genus(c):
    """First whitespace-separated word of a species name."""
    return F.split(F.trim(c), r"\s+")[0]


def strip_list_marks(c):
    """Remove quote and bracket characters left over from a printed list."""
    return F.translate(c, "'[]", "")


def clean_code_list(codes, known):
    """Distinct known codes of an array, sorted and joined with ``', '``."""
    return F.array_join(F.sort_array(F.array_intersect(codes, known)), ", ")


def yes_no(flag, yes, no):
    """Boolean to one of two labels; null counts as no."""
    return F.when(flag, yes).otherwise(no)
