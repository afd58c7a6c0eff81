"""Text functions: Column -> Column, inside whole-stage projections.

Python-style rules that differ between engines are pinned here: white space is
ASCII ``\\s``, an empty string has no words, and entities are decoded only by
``unescape``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token grammar, its stop words and the section-number grammar.
TOKEN = r"[A-Za-z]+|\d+(?:\.\d+)*|\([a-z0-9]{1,4}\)"
STOP = (
    "the", "a", "an", "of", "to", "in", "for", "and", "or", "is", "are", "be", "as", "by", "on", "that", "this", "with", "it", "at", "from", "may",
    "can", "i", "my", "me", "do", "does", "if", "what", "how", "when", "which",
)
CFR_SECTION = r"\d+[a-z]?\.\d+"
USC_SECTION = r"\d+[a-z]?(?:[–-]\d+)?"
SECTION_NO = f"(?:{CFR_SECTION}|{USC_SECTION})"
SECTION_KEY = rf"^(\d+ (?:CFR|U\.S\.C\.) § {SECTION_NO})"
CHAPTER_KEY = r"^(USCIS PM Vol \S+, Pt \S+, Ch \S+?)(?:,|$)"
TOKENS_PER_WORD = 1.33
SPACE = " \t\n\x0b\f\r"

# Question openers that point back, volatile topics, first-person hints.
OPENERS = ("what if", "and ", "but ", "so ", "then ", "what about", "how about", "why ", "no ", "yes ", "it ", "that ", "they ", "he ", "she ", "ok", "okay")
VOLATILE = ("priority date", "visa bulletin", "final action date", "retrogress", "current for", "dates for filing", "backlog")
FIRST_PERSON = ("i ", "my ", "me ", "i'm", "i've", "we ", "our ")
DEONTIC = (
    r"(?i)\b(?:must|cannot|can't|may not|is barred|are barred|is required|are required|is eligible|are eligible|"
    r"not eligible|qualifies|does not qualify|you can|you may|you should|you need to|you have to|you would need)\b"
)
SENTENCE = r"(?<=[.;:])\s+(?=[A-Z(])"
QUOTE_SENTENCE = r"(?<=[.;:])\s+(?=[A-Z(\"'])"
BLOCK = r"\n\s*\n|\n(?=\s*[-*•]|\s*\d+\.)"
ENUM_ITEM = r"(?<![A-Za-z])\((?:i{1,3}|iv|vi{1,3}|ix|xi{0,3}|v|x)\)\s+(?=[A-Z])"
FOOTNOTE = r"\s*\[\d{1,3}\]"
# Named entities the decoder knows besides numeric ones.
ENTITIES = {"nbsp": " ", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "copy": "©", "middot": "·", "ndash": "–", "mdash": "—", "sect": "§", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "hellip": "…", "amp": "&"}


def words(c: Column) -> Column:
    # one regex pass: the ends are trimmed without one
    t = F.btrim(c, F.lit(SPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def at_least_words(c: Column, n: int) -> Column:
    """``n_words(c) >= n`` for n over 1; a text is split no further than that."""
    return F.size(F.split(F.btrim(c, F.lit(SPACE)), r"\s+", n)) >= n


def last_words(c: Column, n: int) -> Column:
    """The last n words, space-joined. The text is split from its end, no further than that."""
    backwards = F.split(F.reverse(F.btrim(c, F.lit(SPACE))), r"\s+", n + 1)
    return F.reverse(F.array_join(F.slice(backwards, 1, n), " "))


def n_tokens(c: Column) -> Column:
    """Estimated model tokens: words times 1.33, rounded down."""
    return F.floor(n_words(c) * F.lit(TOKENS_PER_WORD)).cast("long")


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_html(c: Column) -> Column:
    """Script and style bodies out, tags to spaces, white space collapsed; entities stay."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    return clean(F.regexp_replace(bare, r"<[^>]+>", " "))


def _numeric(c: Column) -> Column:
    """Decimal and hexadecimal character references decoded; impossible ones stay."""

    def one(text: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"&#[xX]?([0-9A-Fa-f]+);", 1)
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
        return F.replace(text, ref, F.coalesce(char, ref))

    refs = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), 0))
    return F.when(c.contains("&#"), F.aggregate(refs, c, one)).otherwise(c)


def unescape(c: Column) -> Column:
    """Numeric and the common named character references decoded, ampersands last."""
    c = _numeric(c)
    for name, ch in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ch))
    return c


def visible(c: Column) -> Column:
    """Tags to spaces, entities decoded, white space collapsed."""
    return clean(unescape(F.regexp_replace(c, r"<[^>]+>", " ")))


def raw_tokens(c: Column) -> Column:
    """Tokens in lower case, stop words and all; [''] for none. One pass, no lambda."""
    return F.split(F.lower(F.array_join(F.regexp_extract_all(c, F.lit(TOKEN), 0), " ")), " ")


def tokenize(c: Column) -> Column:
    stop = F.array(*map(F.lit, (*STOP, "")))
    return F.filter(raw_tokens(c), lambda x: ~F.array_contains(stop, x))


def distinct_terms(c: Column) -> Column:
    """The distinct tokens that are no stop words."""
    return F.array_except(raw_tokens(c), F.array(*map(F.lit, (*STOP, ""))))


def counted_terms(c: Column) -> Column:
    """array<struct<term, tf>> of a text, counted inside the row: equal tokens stand side by
    side once sorted, and a run's length is its count. Nothing is shuffled."""
    # a lambda binds the sorted tokens and the runs' starts once
    stop = F.array(*map(F.lit, (*STOP, "")))

    def runs(t: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.coalesce(F.get(t, i) != F.get(t, i - 1), F.lit(True)))
        return F.get(F.transform(F.array(first), lambda at: F.transform(at, lambda a, k: F.struct(F.get(t, a).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(t)) - a).cast("long").alias("tf")))), 0)

    found = F.get(F.transform(F.array(F.sort_array(raw_tokens(c))), runs), 0)
    return F.filter(found, lambda x: ~F.array_contains(stop, x["term"]))


def section_key(citation: Column) -> Column:
    """The section of a citation, the chapter of a manual citation, or the citation."""
    t = F.trim(citation)
    key = lambda rx: F.nullif(F.regexp_extract(t, rx, 1), F.lit(""))
    return F.coalesce(key(SECTION_KEY), key(CHAPTER_KEY), t)


def sentences(c: Column, pattern: str = SENTENCE) -> Column:
    return F.filter(F.split(F.trim(c), pattern), lambda s: F.trim(s) != "")


def blocks(c: Column) -> Column:
    """Paragraphs and list items, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, BLOCK), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def fold(c: Column) -> Column:
    """Case and quote marks folded one character for one."""
    return F.lower(F.translate(c, "’‘“”", "''\"\""))


def closing_questions(c: Column) -> Column:
    paras = F.filter(F.transform(F.split(c, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    found = F.regexp_extract_all(F.coalesce(F.try_element_at(paras, F.lit(-1)), F.lit("")), F.lit(r"[^.!?\n]*\?"), 0)
    return F.filter(F.transform(found, F.trim), lambda q: q != "")


def needs_context(question: Column) -> Column:
    q = F.lower(F.trim(question))
    return (n_words(q) <= 8) | q.rlike("^(" + "|".join(OPENERS) + ")")


def needs_bulletin(question: Column) -> Column:
    return F.lower(question).rlike("|".join(VOLATILE))


def situational(question: Column, bounded: bool = False) -> Column:
    """Over 12 words with a first-person hint. ``bounded`` asks for a word start, so
    that "time " is no "me "; the default looks for plain substrings."""
    hints = "|".join(FIRST_PERSON)
    return (n_words(question) > 12) & F.concat(F.lit(" "), F.lower(question), F.lit(" ")).rlike(rf"(?<![a-z])({hints})" if bounded else hints)


def norm_words(c: Column, n: int) -> Column:
    return F.slice(words(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " ")), 1, n)


def opens_with(body: Column, heading: Column, n: int = 3) -> Column:
    """Does the body begin with the first words of the heading? An empty heading never does."""
    h = norm_words(heading, n)
    return (F.size(h) > 0) & (F.slice(norm_words(body, n), 1, F.greatest(F.size(h), F.lit(1))) == h)


def next_letter(cur: Column, cand: Column) -> Column:
    """Is cand the strict successor of cur in a, b .. z, aa, bb ..? '' is followed by a."""
    one = (F.length(cur) == F.length(cand)) & (F.ascii(cand) - F.ascii(cur) == 1)
    same = (F.replace(cur, F.substring(cur, 1, 1), F.lit("")) == "") & (F.replace(cand, F.substring(cand, 1, 1), F.lit("")) == "")
    longer = (F.length(cand) == F.length(cur) + 1) & (F.replace(cur, F.lit("z"), F.lit("")) == "") & (F.replace(cand, F.lit("a"), F.lit("")) == "")
    return F.when(cur == "", cand == "a").otherwise((one & same) | longer)


def promises_list(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "").endswith(":")


def label(heading: Column) -> Column:
    return F.regexp_extract(heading, r"^([A-Z]|\d{1,2})\.\s", 1)


def fingerprint(c: Column, chars: int = 90) -> Column:
    return F.substring(clean(c), 1, chars)


def squash(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def content_words(c: Column, stop: tuple[str, ...] = STOP) -> Column:
    """Distinct lower-case ASCII words of over two letters that are no stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0)
    s = F.array(*map(F.lit, stop))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(s, w)))


def echoes(applies: Column, quote: Column) -> Column:
    a, q = fold(clean(applies)), fold(clean(quote))
    return a.contains(F.substring(q, 1, 60)) | q.contains(F.substring(a, 1, 60))


def issue_lines(raw: Column, least: int = 8, most: int = 140, keep: int = 6) -> Column:
    """Lines without bullets or numbers, of a sensible length, the first few."""
    bare = F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])?\s*", "")))
    return F.slice(F.filter(bare, lambda x: (F.length(x) > least) & (F.length(x) < most)), 1, keep)


def usable_words(text: Column) -> Column:
    """Words after the header line and the suspension markers."""
    body = F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)$", 1)
    body = F.when(body == "", text).otherwise(body)
    return n_words(F.regexp_replace(body, r"\[SUSPENDED — withheld:[^\]]*\]", " "))


def month_template(template: Column, month: Column) -> Column:
    """{month} (full name, lower case) and {year} filled in."""
    return F.replace(F.replace(template, F.lit("{month}"), F.lower(F.date_format(month, "MMMM"))), F.lit("{year}"), F.date_format(month, "yyyy"))
