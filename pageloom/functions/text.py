"""Text functions as column expressions: cleaning, counting, reading level, token estimates, frontmatter."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it.
WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Entity, and what it stands for, in the order of replacement: "&amp;lt;" becomes "<".
ENTITIES = (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#039", "'"), ("apos", "'"), ("ndash", "–"), ("mdash", "—"), ("hellip", "…"), ("ldquo", '"'), ("rdquo", '"'), ("lsquo", "‘"), ("rsquo", "’"))
#: Levels by their highest grade; above them it is "expert".
LEVELS = ((5, "elementary"), (8, "intermediate"), (12, "advanced"))
INTERFACE = "Copy link|Email|Facebook|Jump to|LinkedIn|Menu|Navigate to|Print|Search|Share|Skip to|Tweet"
TEASERS = "Click here|Continue reading|Read more|See more|View all"
CLUTTER = "ads|advertisement|comment|menu|modal|nav|popup|share|sidebar|social"
#: One-line elements that are no part of an article, for Java and for Python.
NON_ARTICLE = (
    *(rf"(?i)<{tag}\b[^>]*>.*?</{tag}>" for tag in ("nav", "header", "footer", "aside", "form")),
    *(rf'(?i)<div[^>]*{name}="[^"]*(?:{CLUTTER})[^"]*"[^>]*>.*?</div>' for name in ("class", "id")),
)
ATTRIBUTES = (r'(?i)\s*class="[^"]*"', r'(?i)\s*id="[^"]*"', r'(?i)\s*data-[^=]*="[^"]*"')


#: The same for Java, which is done with an ASCII character after two tests: without and with line breaks.
_LINE_WS = r"[ \t\x0B\f\r[\x{A0}-\x{FEFF}&&[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
_WS = _LINE_WS.replace(r"[ \t", r"[ \t\n")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once for each row, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def _flat(text: Column) -> Column:
    """With single blanks, those at the ends too."""
    return F.regexp_replace(text, rf"{_WS}+", " ")


def _blanks(flat: Column) -> Column:
    return F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))


def trim_lines(c: Column) -> Column:
    """Lines without white space at their ends; a run of it is looked at from its beginning only."""
    ended = F.regexp_replace(c, rf"{_LINE_WS}(?<!{_LINE_WS}{{2}}){_LINE_WS}*+(?=\n|\z)", "")
    return F.regexp_replace(ended, rf"(\A|\n){_LINE_WS}++", "$1")


def strip_html(html: Column) -> Column:
    """Text without scripts, styles and tags; what tags parted is joined without a space."""
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"<[^>]+>"):
        html = F.regexp_replace(html, pattern, "")
    return F.trim(_flat(html))


def decode_entities(text: Column) -> Column:
    """Named entities, then decimal and hexadecimal ones."""

    def named(t: Column) -> Column:
        for name, char in ENTITIES:
            t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
        return t

    def numeric(t: Column) -> Column:
        return bound(_numeric(t, r"&#(\d{1,7});", 10, 3), lambda u: _numeric(u, r"&#[xX]([0-9a-fA-F]{1,6});", 16, 4))

    read = lambda t: bound(named(t), lambda u: F.when(u.contains("&#"), numeric(u)).otherwise(u))
    return bound(text, lambda t: F.when(t.contains("&"), read(t)).otherwise(t))


def _numeric(text: Column, pattern: str, base: int, skip: int) -> Column:
    def put(t: Column, e: Column) -> Column:
        return F.replace(t, e, _char(F.conv(F.substring(e, F.lit(skip), F.length(e) - skip), base, 10).cast("int")))

    return F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0)), text, put)


def _char(code: Column) -> Column:
    """The character of a code below 65536; larger ones wrap around, as 16-bit units do."""
    unit = code.bitwiseAND(F.lit(0xFFFF))
    hex4 = F.lpad(F.hex(unit), 4, "0")
    return F.decode(F.unhex(hex4), "UTF-16BE")


def normalize_whitespace(text: Column) -> Column:
    text = F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), " {2,}", " ")
    return F.regexp_replace(trim_lines(text), r"\n{3,}", "\n\n")


def detect_paragraphs(text: Column) -> Column:
    """Blank lines go; one is put after a line of over 40 characters that ends a sentence before one of over 20 that begins one."""
    return _paragraphs(F.filter(F.split(text, "\n"), lambda x: F.length(strip_space(x)) > 0))


def _paragraphs(lines: Column) -> Column:
    def mark(x: Column, following: Column) -> Column:
        return F.when(x.rlike(r"[.!?]$") & following.rlike("^[A-Z0-9]") & (F.length(x) > 40) & (F.length(following) > 20), F.concat(x, F.lit("\n"))).otherwise(x)

    # an index into the lines inside a lambda would look one up for every line
    return bound(lines, lambda ls: F.array_join(F.zip_with(ls, F.slice(ls, F.lit(2), F.greatest(F.size(ls), F.lit(0))), mark), "\n"))


def clean_text(text: Column) -> Column:
    # normalized lines have no white space at their ends
    return strip_space(_paragraphs(F.filter(F.split(normalize_whitespace(decode_entities(text)), "\n"), lambda x: x != "")))


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, rf"https?://[^{WS[1:]}+", "")


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space among them, and an ellipsis."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.+) ", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(cut != "", cut).otherwise(head), F.lit("…")))


def strip_non_article(html: Column) -> Column:
    """Without one-line navigation, forms and clutter, and without class, id and data attributes."""
    html = F.coalesce(html, F.lit(""))
    for pattern in (*NON_ARTICLE, *ATTRIBUTES):
        html = F.regexp_replace(html, pattern, "")
    return html


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(bound(F.trim(_flat(text)), _words_of), F.lit(0)).cast("long")


def _words_of(flat: Column) -> Column:
    return F.when(flat == "", 0).otherwise(_blanks(flat) + 1)


def reading_time(count: Column) -> Column:
    """Minutes at 200 words a minute."""
    return F.ceil(count / 200).cast("long")


def excerpt(text: Column, most: int = 200, always: bool = False) -> Column:
    """The first characters; an ellipsis always, or only where something is cut."""
    head = F.substring(text, 1, most)
    return F.concat(head, F.lit("...")) if always else F.when(F.length(text) > most, F.concat(head, F.lit("..."))).otherwise(head)


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, more for URLs, code blocks, numbers and characters beyond ASCII."""
    return F.coalesce(bound(text, lambda t: F.when(t == "", 0).otherwise(bound(F.trim(_flat(t)), _tokens_of))), F.lit(0)).cast("long")


def _tokens_of(flat: Column) -> Column:
    """The estimate for a text that is computed once and bound to a variable; rare things are looked for only where they can be."""
    rare = lambda mark, pattern, n: F.when(flat.contains(mark), F.regexp_count(flat, F.lit(pattern)) * n).otherwise(0)
    missing = lambda pattern: F.length(flat) - F.length(F.regexp_replace(flat, pattern, ""))
    beyond = F.when(F.octet_length(flat) > F.length(flat), missing(r"[^\x00-\x7F]+")).otherwise(0)
    wide = F.when(F.octet_length(flat) > F.length(flat), missing(r"[\x{10000}-\x{10FFFF}]+")).otherwise(0)
    numbers = bound(F.trim(F.regexp_replace(flat, "[^0-9]+", " ")), _words_of)
    return F.ceil((F.length(flat) + wide) / 4) + rare("://", r"https?://[^ ]+", 5) + rare("```", r"(?s)```.*?```", 10) + F.floor(numbers * 0.5) + beyond + wide


def simple_tokens(text: Column) -> Column:
    return F.ceil(F.coalesce(utf16_length(text), F.lit(0)) / 4).cast("long")


def within_token_limit(text: Column, limit: int) -> Column:
    return estimate_tokens(text) <= limit


def sentence_count(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1)).cast("long")


def syllable_count(text: Column) -> Column:
    """Of each piece between white space its letters: of up to three, one syllable; else one for each group of vowels,
    but for an e at the end after another group, one more for a consonant and "le" at the end, and at least one."""
    return bound(_flat(text), _syllables_of).cast("long")


def _syllables_of(flat: Column) -> Column:
    """From the whole text at once, as a look at every word by itself takes many times as long."""
    letters = F.regexp_replace(F.lower(flat), "[^a-z ]+", "")
    # of the longer words: each group of vowels becomes an "a", or an "E" where it ends the word with an e
    longer = F.regexp_replace(F.concat(F.lit(" "), letters, F.lit(" ")), " [a-z]{1,3}(?= )", " ")

    def count(ended: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(ended, "[aeiouy]+E", "E"), "[aeiouy]+", "a")
        return bound(marked, groups) + F.regexp_count(ended, F.lit("lE(?<=[b-df-hj-np-tv-xz]lE)"))

    def groups(m: Column) -> Column:
        # a word without vowels is one syllable, as is a short one
        vowels = 2 * F.length(m) - F.length(F.replace(m, F.lit("a"), F.lit(""))) - F.length(F.replace(m, F.lit("E"), F.lit("")))
        return vowels - F.regexp_count(m, F.lit("a[b-z]*E")) - F.regexp_count(m, F.lit(" [b-z]*[aE]"))

    return _blanks(flat) + 1 + bound(F.replace(longer, F.lit("e "), F.lit("E ")), count)


def reading_grade(text: Column) -> Column:
    """Flesch-Kincaid grade, one decimal, at least 0; 0 without words."""

    def of(flat: Column) -> Column:
        return bound(_words_of(F.trim(flat)), lambda n: F.when(n > 0, graded(flat, n)).otherwise(F.lit(0.0)))

    def graded(flat: Column, n: Column) -> Column:
        raw = F.lit(0.39) * (n / sentence_count(flat)) + F.lit(11.8) * (_syllables_of(flat) / n) - F.lit(15.59)
        return F.greatest(F.floor(raw * 10 + 0.5) / 10, F.lit(0.0))

    return F.coalesce(bound(_flat(text), of), F.lit(0.0)).cast("double")


def reading_level(grade: Column) -> Column:

    def named(g: Column) -> Column:
        out = F.when(g <= LEVELS[0][0], LEVELS[0][1])
        for most, name in LEVELS[1:]:
            out = out.when(g <= most, name)
        return out.otherwise("expert")

    return bound(grade, named)


def clean_for_llm(text: Column) -> Column:
    """Without interface lines and teasers, with single spaces and at most one blank line that was there before."""
    text = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, rf"(?im)^({INTERFACE}).*$", "")
    text = bound(text, _without_teasers)
    return strip_space(trim_lines(F.regexp_replace(text, r"[ \t]+", " ")))


def _without_teasers(text: Column) -> Column:
    """The pattern is tried at every character, so only where one of them is."""
    low = F.lower(text)
    some = functools.reduce(Column.__or__, (low.contains(t.lower()) for t in TEASERS.split("|")))
    return F.when(some, F.regexp_replace(text, rf"(?i)\[?({TEASERS})\.?\]?", "")).otherwise(text)


def escape_yaml(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))


def frontmatter(title: Column, url: Column, words: Column, minutes: Column, tokens: Column, author: Column | None = None, date: Column | None = None, site: Column | None = None, language: Column | None = None, level: Column | None = None, grade: Column | None = None) -> Column:
    """A YAML block; fields that are null or empty are left out."""

    def line(name: str, c: Column | None, quoted: bool = False) -> Column:
        if c is None:
            return F.lit(None).cast("string")
        value = F.concat(F.lit('"'), escape_yaml(c), F.lit('"')) if quoted else c.cast("string")
        return F.when(c.cast("string") != "", F.concat(F.lit(f"{name}: "), value))

    lines = [line("author", author, True), line("date", date), line("source", site, True), line("language", language), line("word_count", words), line("reading_time", minutes), line("tokens", tokens), line("reading_level", level), line("reading_grade", grade)]
    top = F.concat(F.lit('title: "'), escape_yaml(F.coalesce(title, F.lit(""))), F.lit('"'))
    return F.concat(F.concat_ws("\n", F.lit("---"), top, F.concat(F.lit("url: "), F.coalesce(url, F.lit(""))), *lines, F.lit("---")), F.lit("\n"))


def _tenths(n: Column, unit: int) -> Column:
    """n / unit with one decimal, halves up, from integers."""
    t = F.floor((n * 10 + unit // 2) / unit).cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1 << 20, F.concat(_tenths(n, 1024), F.lit("KB"))).otherwise(F.concat(_tenths(n, 1 << 20), F.lit("MB")))


def format_duration(ms: Column) -> Column:
    seconds = F.floor(ms.cast("double") % 60000 / 1000 + 0.5).cast("long").cast("string")
    whole = F.floor(ms / 60000).cast("long").cast("string")
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.concat(_tenths(ms, 1000), F.lit("s"))).otherwise(F.concat(whole, F.lit("m "), seconds, F.lit("s")))


def parse_date(text: Column) -> Column:
    """A timestamp from ISO 8601, RFC 822 (the weekday is skipped), "Month d, yyyy" and MM/dd/yyyy; null if none fits."""
    bare = F.trim(F.regexp_replace(text, r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""))
    shapes = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm[:ss][.SSS][XXX]", "yyyy-MM-dd HH:mm[:ss][.SSS]", "d MMM yyyy HH:mm[:ss] [xx][z]", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(s)) for s in shapes))


def input_type(c: Column) -> Column:
    """"url", "html-string" or "unsupported"."""
    return F.when(F.trim(c).rlike("(?i)^https?://"), "url").when(c.rlike(r"(?s)</?[A-Za-z].*>"), "html-string").otherwise("unsupported")


def feed_type(content_type: Column) -> Column:
    low = F.lower(content_type)
    return F.when(low.contains("atom"), "atom").when(low.contains("rdf"), "rdf").otherwise("rss")


def feed_like(href: Column, text: Column) -> Column:
    """Whether a link may lead to a feed."""
    return F.lower(F.concat_ws(" ", href, text)).rlike("rss|feed|atom|xml|syndication")
