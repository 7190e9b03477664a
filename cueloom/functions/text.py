"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of query parameters whose values are secret.
SECRET_NAMES = ("key", "api_key", "apikey", "api-key", "token", "access_token", "auth", "authorization", "secret", "password", "pass", "pwd", "sk")

#: Characters per second that a reader follows, by start of the code or name of the language; others 17.
READING_SPEED = {("zh", "chinese"): 9, ("ja", "japanese"): 4, ("ko", "korean"): 7}
DEFAULT_SPEED = 17

#: Words that a cue should not end with.
BAD_ENDINGS = (
    "the", "a", "an",
    "this", "that", "these", "those", "my", "your", "his", "her", "its", "our", "their",
    "of", "in", "on", "at", "by", "for", "with", "to", "from", "as", "into", "onto", "about",
    "and", "or", "but", "so", "yet", "nor", "if", "while", "when", "where", "because", "since",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "shall", "should", "may", "might", "must", "can", "could",
)

#: Language aliases, and the codes of two services and of ISO 639-2.
LANGUAGES = (
    ("zh-hans", "zh-CN", "zh-Hans", "zho"),
    ("zh-cn", "zh-CN", "zh-Hans", "zho"),
    ("chinese", "zh-CN", "zh-Hans", "zho"),
    ("zh-hant", "zh-TW", "zh-Hant", "zho"),
    ("zh-tw", "zh-TW", "zh-Hant", "zho"),
    ("zh", None, None, "zho"),
    ("en", "en", "en", "eng"),
    ("english", "en", "en", "eng"),
    ("ja", "ja", "ja", "jpn"),
    ("japanese", "ja", "ja", "jpn"),
    ("ko", "ko", "ko", "kor"),
    ("korean", "ko", "ko", "kor"),
    ("fr", "fr", "fr", "fra"),
    ("french", "fr", "fr", "fra"),
    ("de", "de", "de", "deu"),
    ("german", "de", "de", "deu"),
    ("es", "es", "es", "spa"),
    ("spanish", "es", "es", "spa"),
    ("ru", None, None, "rus"),
    ("russian", None, None, "rus"),
    ("pt", None, None, "por"),
    ("portuguese", None, None, "por"),
)


def trim(s: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+", "")


def tokens(s: Column) -> Column:
    """Words between Unicode white space; none for blank text."""
    return F.array_remove(F.split(s, r"(?U)\s+"), "")


def alpha_lower(s: Column) -> Column:
    """Letters only, in lower case."""
    return F.lower(F.regexp_replace(s, r"[^\p{L}]", ""))


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; hours widen beyond 99."""
    return F.format_string("%02d:%02d:%02d,%03d", *[x.cast("long") for x in (F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)])


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc."""
    return F.format_string("%d:%02d:%02d.%02d", *[x.cast("long") for x in (F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), F.floor(ms % 1000 / 10))])


def parse_srt_time(s: Column) -> Column:
    """Milliseconds of HH:MM:SS with a fraction of any length, or of seconds as a decimal; null for anything else."""
    t = trim(s)
    clock = r"^\+?(\d+):\+?(\d+):\+?(\d+)(?:[,.](\d+))?$"
    part = lambda i: F.regexp_extract(t, clock, i)
    whole = (part(1).try_cast("long") * 3600 + part(2).try_cast("long") * 60 + part(3).try_cast("long")) * 1000
    fraction = F.rpad(F.substring(part(4), 1, 3), 3, "0").try_cast("long")
    seconds = F.regexp_extract(F.replace(t, F.lit(","), F.lit(".")), r"^\+?(\d+(?:\.\d*)?|\.\d+)$", 1)
    return F.when(t.rlike(clock), whole + fraction).when(seconds != "", F.floor(seconds.try_cast("double") * 1000).cast("long"))


#: A span as most files have it; its times are read by their places.
USUAL_SPAN = r"^[0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3} --> [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}\z"


def parse_srt_span(line: Column) -> tuple[Column, Column]:
    """Start and end of 'a --> b'; both null unless both can be read."""
    parts = F.split(line, "-->")
    a, b = (parse_srt_time(F.get(parts, F.lit(i))) for i in (0, 1))
    ok = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    usual = line.rlike(USUAL_SPAN)
    digits = lambda at, n: F.substring(line, at, n).cast("long")
    placed = lambda at: ((digits(at, 2) * 60 + digits(at + 3, 2)) * 60 + digits(at + 6, 2)) * 1000 + digits(at + 9, 3)
    return F.when(usual, placed(1)).when(ok, a), F.when(usual, placed(18)).when(ok, b)


def script_language(s: Column) -> Column:
    """zh, ja, ko or en by the share of scripts."""
    share = lambda kind: F.length(F.regexp_replace(s, f"[^{kind}]", ""))
    total = F.greatest(F.length(s), F.lit(1))
    han, kana, hangul = share(r"\x{4e00}-\x{9fff}"), share(r"\x{3040}-\x{30ff}"), share(r"\x{ac00}-\x{d7af}")
    return F.when(han / total > 0.2, "zh").when((kana / total > 0.2) | ((han > 0) & (kana > 0)), "ja").when(hangul / total > 0.2, "ko").otherwise("en")


def redact(s: Column) -> Column:
    """Secret query parameters and bearer tokens as ***."""
    names = "|".join(SECRET_NAMES)
    hidden = F.regexp_replace(s, rf"(?iU)([?&])({names})=[^&\s\"',)]*", "$1$2=***")
    return F.regexp_replace(hidden, r"Bearer [A-Za-z0-9\-._+/=]*", "Bearer ***")


def unescape_html(s: Column) -> Column:
    """Five entities, one after the other: what &amp; frees is read again."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return s


def after_marker(s: Column, marker: str, stop: str = "<") -> Column:
    """Text between a marker and the next stop; null without either."""
    found = F.regexp_extract(s, rf"\Q{marker}\E([^{stop}]*){stop}", 1)
    return F.when(s.rlike(rf"\Q{marker}\E[^{stop}]*{stop}"), found)


def url_encode(s: Column) -> Column:
    """Percent-encoding of all but letters, digits, '-', '.', '_' and '~'."""
    out = F.url_encode(s)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def colour(s: Column) -> Column:
    """#RRGGBB in upper case; null if it isn't six hex digits."""
    bare = F.regexp_replace(trim(s), "^#+", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper(bare)))


def ass_colour(s: Column) -> Column:
    """&H00BBGGRR; null if it isn't a colour."""
    c = colour(s)
    return F.concat(F.lit("&H00"), F.substring(c, 6, 2), F.substring(c, 4, 2), F.substring(c, 2, 2))


def font_to_ass(s: Column) -> Column:
    """Font tags as colour overrides, line ends as hard breaks."""
    tag = r"<font color=[\"']#([0-9A-Fa-f]{2})([0-9A-Fa-f]{2})([0-9A-Fa-f]{2})[\"']>"
    parts = F.split(F.regexp_replace(s, f"({tag})", "\u0001$1\u0001"), "\u0001")
    override = lambda x: F.upper(F.regexp_replace(x, tag, "{\\\\c&H00$3$2$1&}"))
    pieces = F.transform(parts, lambda x: F.when(x.rlike(f"^{tag}$"), override(x)).otherwise(x))
    joined = F.replace(F.array_join(pieces, ""), F.lit("{\\C&H00"), F.lit("{\\c&H00"))
    return F.replace(F.replace(joined, F.lit("</font>"), F.lit("{\\r}")), F.lit("\n"), F.lit("\\N"))


def font_wrap(s: Column, colour_of: Column) -> Column:
    """The text in a font tag, where there is a colour."""
    c = colour(colour_of)
    return F.when(c.isNull(), s).otherwise(F.concat(F.lit('<font color="'), c, F.lit('">'), s, F.lit("</font>")))


def layout(kind: Column, source: Column, target: Column, target_colour: Column | None = None, source_colour: Column | None = None) -> Column:
    """target-above, source-above or target-only; anything else is source only. An empty translation leaves the source."""
    shown = target if target_colour is None else font_wrap(target, target_colour)
    below = source if source_colour is None else font_wrap(source, source_colour)
    return (
        F.when(target == "", below)
        .when(kind == "target-above", F.concat_ws("\n", shown, below))
        .when(kind == "source-above", F.concat_ws("\n", below, shown))
        .when(kind == "target-only", shown)
        .otherwise(below)
    )


def max_chars(duration_ms: Column, language: Column) -> Column:
    """Characters that can be read in a cue's time, 4 at least."""
    speed = F.lit(DEFAULT_SPEED)
    low = F.lower(language)
    for (code, name), cps in READING_SPEED.items():
        speed = F.when(low.startswith(code) | low.contains(name), cps).otherwise(speed)
    return F.greatest(F.lit(4), F.floor(duration_ms / 1000 * speed)).cast("int")


def failure_class(status: Column) -> Column:
    return F.when((status == 429) | (status >= 500), "transient").otherwise("permanent")


def fingerprint(parts: list[Column], config: Column) -> Column:
    """16 hex digits of what identifies the input, and 16 of the configuration."""
    digest = lambda s: F.substring(F.sha2(s.cast("binary"), 256), 1, 16)
    return F.concat(digest(F.concat_ws("|", *[p.cast("string") for p in parts])), F.lit("_"), digest(config))


def predicted_outputs(path: Column, root: Column, out_root: str | None, mode: str) -> Column:
    """Paths that a run over ``path`` writes. mode: text, hard, soft or both."""
    directory, name = F.regexp_replace(path, "/[^/]*$", ""), F.regexp_extract(path, "([^/]*)$", 1)
    if out_root is not None:
        inside = F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.expr("1") * F.length(root) + 1).otherwise(0)
        directory = F.concat(F.lit(out_root), F.when(inside > 0, F.substring(directory, inside, F.length(directory))).otherwise(""))
    stem, ext = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r".\.([^.]*)$", 1)
    if mode == "text":
        end = F.when(stem.endswith("_translated"), ".srt").otherwise("_translated.srt")
        return F.array(F.concat(directory, F.lit("/"), stem, end))
    kind = F.lit("mkv") if mode == "soft" else ext
    made = lambda mark: F.concat(directory, F.lit("/"), stem, F.lit(f"_captioned{mark}."), kind)
    return F.array(made(""), made("_softsub")) if mode == "both" else F.array(made(""))


#: A JSON array of arrays of numbers.
PAIRS = r"^\s*\[\s*(?:\[[\d,\s]*\]\s*(?:,\s*\[[\d,\s]*\]\s*)*+)?\]\s*$"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A JSON array of strings.
STRINGS = rf"(?s)^\s*\[\s*(?:{_STRING}\s*(?:,\s*{_STRING}\s*)*+)?\]\s*$"


def fenced_block(s: Column) -> Column:
    """What stands in the first block fenced as json, else in the first fenced without a name; null without either."""
    named, bare = (rf"(?s)```{name}\n(.*?)```" for name in ("json", ""))
    inside = lambda pattern: F.when(s.rlike(pattern), trim(F.regexp_extract(s, pattern, 1)))
    return F.coalesce(inside(named), inside(bare))


def string_array(s: Column, expected: Column) -> Column:
    """A JSON array of exactly ``expected`` strings; null otherwise."""
    parsed = F.from_json(s, "array<string>")
    return F.when(s.rlike(STRINGS) & (F.size(parsed) == expected), parsed)
