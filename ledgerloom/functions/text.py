"""String functions over descriptions, names and labels, as Column -> Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space, in a form that Java and RE2 both read.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Characters that a search query must not hold.
QUERY_NOISE = r"\[|\]|\{|\}|\"|/|\\|:|\(|\)|-|\+|<|>|'|!|\*|\|\||&&|~"

# Patterns and words that carry no meaning in a description, in the order they are tried.
NOISE_PATTERNS = (r"^ach", r"\d{2}\/\d{2}", r"X{4}\d{4}X{5}\d{4}", r"~{2}\d{5}~{2}\d{16}~{2}\d{5}~{2}\d~{4}\d{4}", r"checkcard \d{4}", r"\d{15}")
NOISE_WORDS = (" pos ", r"^pos ", " ach ", "electronic", "debit", "purchase", " card ", " pin ", "recurring", " check ", "checkcard", "qps", "q35", "q03", " sq ")

# Spellings of merchants and what the directory calls them.
SYNONYMS = {
    "wal-mart": " Walmart ",
    "wal mart": " Walmart ",
    "samsclub": " Sam's Club ",
    "usps": " US Post Office ",
    "lowes": " Lowe's ",
    "wholefds": " Whole Foods ",
    "shell oil": " Shell Gas ",
    "wm supercenter": " Walmart ",
    "exxonmobil": " exxonmobil exxon mobil ",
    "mcdonalds": " mcdonald's ",
    "costco whse": " costco ",
    "franciscoca": " francisco ca ",
    "qt": " Quicktrip ",
    "macy's east": " Macy's ",
}

# Words that stay small in a label.
SMALL_WORDS = ("by", "with", "or", "at", "in")

PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def clean_query(text: Column) -> Column:
    """Text that is safe in a search query, in lower case."""
    return F.lower(squeeze(F.regexp_replace(text, QUERY_NOISE, " ")))


def clean_panel(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(text, "'", " "), r"\*<", " "))


def strip_noise(text: Column) -> Column:
    """Drops patterns and words without meaning, in one pass, and raises the rest to capitals."""
    return F.upper(squeeze(F.regexp_replace(F.lower(text), "|".join(NOISE_PATTERNS + NOISE_WORDS), " ")))


def one_pass_replace(text: Column, mapping: dict[str, str]) -> Column:
    """Replaces all keys in a single pass from left to right, so that no replacement is replaced again.
    Matches are fenced by a character that text cannot hold, the text is cut there and every second
    piece looked up."""
    fence = "\ue000"
    special = r"\.+*?()[]{}|^$-"
    keys = "|".join("".join("\\" + c if c in special else c for c in k) for k in mapping)
    pieces = F.split(F.regexp_replace(text, f"({keys})", f"{fence}$1{fence}"), fence)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.element_at(table, p)).otherwise(p)), "")


def replace_synonyms(text: Column) -> Column:
    return F.upper(one_pass_replace(F.lower(text), SYNONYMS))


def capitalise_label(text: Column) -> Column:
    """Each word with a capital, the rest of it as it is; small words in lower case."""
    word = lambda w: F.when(F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(F.transform(F.split(text, " ", -1), word), " ")


def capwords_if_upper(name: Column) -> Column:
    """Names in capitals become words with a capital; others stay."""
    words = F.transform(F.split(name, " ", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.when(name == F.upper(name), F.array_join(words, " ")).otherwise(name)


def bare_upper(text: Column) -> Column:
    """Capitals without white space and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.upper(text), SPACE, ""), PUNCTUATION, "")


def token_starts(text: Column) -> Column:
    """Where each token begins in the text without blanks and punctuation, and where the last ends."""
    flat = F.regexp_replace(F.regexp_replace(text, "'", ""), PUNCTUATION, " ")
    tokens = F.filter(F.split(squeeze(flat), " "), lambda t: t != "")
    start = F.array(F.lit(0))
    return F.aggregate(tokens, start, lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(t))))


def split_label(label: Column, ledger: Column, container: Column) -> tuple[Column, Column]:
    """(type, subtype) of 'Type - Subtype'; labels without the separator get the ledger's default."""
    given = F.when(label.contains(" - "), label)
    default = F.when(ledger == "debit", "Other Expenses - Debit").when((ledger == "credit") & (container == "bank"), "Other Income - Credit").when((ledger == "credit") & (container == "card"), "Bank Adjustment - Adjustment")
    parts = F.split(F.coalesce(given, default), " - ")
    return F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))


def coordinate(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.6f", value.cast("double")))


def container_of(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("bank"), "bank").when(low.contains("card"), "card").otherwise("")


def contains_folded(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def zip_prefix(code: Column) -> Column:
    return F.substring(code, 1, 5)


def accuracy_literal(text: Column) -> Column:
    """digits.digits as a number, anything else as 0."""
    return F.when(text.rlike(r"^[0-9]+\.[0-9]+$"), text.try_cast("double")).otherwise(F.lit(0.0))


def city_short_forms(city: Column) -> Column:
    """All spellings of a town that arise by shortening any subset of its landform words, squeezed."""
    pairs = {"EAST": "E", "WEST": "W", "NORTH": "N", "SOUTH": "S", "SAINT": "ST", "FORT": "FT", "BEACH": "BCH"}  # fixed values
    table = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
    tokens = F.filter(F.split(squeeze(F.replace(F.upper(city), F.lit("."), F.lit(""))), " "), lambda t: t != "")
    both = lambda acc, t: F.when(F.element_at(table, t).isNotNull(), F.concat(F.transform(acc, lambda a: F.concat(a, t)), F.transform(acc, lambda a: F.concat(a, F.element_at(table, t))))).otherwise(F.transform(acc, lambda a: F.concat(a, t)))
    return F.array_distinct(F.aggregate(tokens, F.array(F.lit("")), both))


def city_long_form(city: Column) -> Column:
    """The town with its landform words in full and capitals at the head of words."""
    pairs = {"E": "EAST", "W": "WEST", "N": "NORTH", "S": "SOUTH", "ST": "SAINT", "FT": "FORT", "BCH": "BEACH"}  # fixed values
    table = F.create_map(*[F.lit(x) for p in pairs.items() for x in p])
    tokens = F.split(squeeze(F.replace(F.upper(city), F.lit("."), F.lit(""))), " ")
    long = F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), t))
    return F.array_join(F.transform(long, lambda t: F.concat(F.substring(t, 1, 1), F.lower(F.substr(t, F.lit(2))))), " ")


def merchant_tags(text: Column, tagged: Column, most: int = 35) -> Column:
    """(token, tag) of the first `most` tokens of a description: a token is tagged merchant if it holds
    the next word of the tag string that was not met yet."""
    tokens = F.slice(F.filter(F.split(squeeze(F.lower(text)), " "), lambda t: t != ""), 1, most)
    wanted = F.filter(F.split(squeeze(F.lower(F.regexp_replace(tagged, ",", " "))), " "), lambda t: ~t.isin("", "null"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<token:string,tag:string>>").alias("out"))

    def step(acc: Column, token: Column) -> Column:
        head = F.get(wanted, acc["at"] - 1)
        hit = F.coalesce(F.contains(token, head), F.lit(False))
        item = F.struct(token.alias("token"), F.when(hit, "merchant").otherwise("background").alias("tag"))
        return F.struct((acc["at"] + F.when(hit, 1).otherwise(0)).alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def merchant_of_tags(tags: Column) -> Column:
    return F.array_join(F.transform(F.filter(tags, lambda t: t["tag"] == "merchant"), lambda t: t["token"]), " ")


def version_stamp(instant: Column) -> Column:
    """Fourteen digits of an instant in the session's time zone, which is UTC."""
    return F.date_format(instant, "yyyyMMddHHmmss")


def score_text(log_score: Column) -> Column:
    """The probability of a logarithm in six significant digits, without zeros at the end."""
    p = F.exp(log_score)
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(p, F.lit(1e-300))))))
    plain = F.regexp_replace(F.format_string("%.10f", F.bround(p * scale, 0) / scale), r"\.?0+$", "")
    return F.when(p >= 1e-4, plain).otherwise(F.regexp_replace(F.format_string("%.5e", p), r"\.?0*e", "e"))


def model_path(kind: str) -> str:
    """bank_debit_subtype -> bank/debit/subtype."""
    return kind.strip("._/").replace("_", "/")


def model_name(path: str) -> str:
    """/bank/debit/ -> bank.debit."""
    return path.strip("/").replace("/", ".").lstrip(".")
