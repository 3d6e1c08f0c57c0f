"""Column expressions over free text. No actions, no Python per row."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body) -> Column:
    """Bind ``value`` once so that nested lambdas do not evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Both-sided strip of every white-space character, not only the space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def all_grams(c: Column, size: int) -> Column:
    """Every run of ``size`` characters; none when the text is shorter."""
    starts = F.sequence(F.lit(1), F.length(c) - size + 1)
    runs = F.transform(starts, lambda at: F.substring(c, at, F.lit(size)))
    return F.when(F.length(c) >= size, runs).otherwise(F.array().cast("array<string>"))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def norm_ws(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def squeeze(c: Column) -> Column:
    """``norm_ws`` of text whose only white space is the space: most texts are looked at, not rewritten."""
    return F.trim(F.when(c.contains("  "), F.regexp_replace(c, "  +", " ")).otherwise(c))


# ---------------------------------------------------------------- segmentation

def line_segments(c: Column) -> Column:
    """Non-blank stripped lines."""
    lines = F.split(F.coalesce(c, F.lit("")), r"\R")
    return F.filter(F.transform(lines, strip), lambda s: s != "")


def line_units(c: Column, mode: str = "both") -> Column:
    """Units to index: the joined text (``full``), each line (``segments``), or ``both``."""
    if mode not in ("full", "segments", "both"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "segments":
        return line_segments(c)

    def units(lines: Column) -> Column:
        full = F.filter(F.array(F.array_join(lines, " ")), lambda s: s != "")
        return full if mode == "full" else F.concat(full, lines)

    return let(line_segments(c), units)


# Patterns fixed by the data format, for text with normal white space: a heading line, a bullet, a sentence end.
HEADING = r"^[^.!?]{2,120}:\z"
BULLET = r"^[-*•] ?"
SENTENCE_GAP = r"([.!?]) (?=[A-ZÁÉÍÓÚÜÑ0-9])"
OTHER_SPACE = r"(?U)[\s&&[^ \r\n]]"
# Unicode non-characters: never part of interchanged text, so safe as marks.
BLOCK_MARK, HEAD_MARK, GAP_MARK = "\ufdd0", "\ufdd1", "\ufdd2"


def fold(c: Column) -> Column:
    """Lower case with the two foldings that differ from plain lower-casing."""
    return F.replace(F.replace(F.lower(c), F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))


def is_heading(line: Column) -> Column:
    return line.endswith(":") & line.rlike(HEADING)


def semantic_segments(c: Column) -> Column:
    """Blocks split at blank lines and headings, then at sentence ends, without repeats.

    Each line is rewritten with a mark where a block starts, the lines are
    joined and cut at the marks: linear in the text, within one row, no shuffle.
    Every step is an array of its own, since a lambda evaluates its argument each time it is named.
    """

    def mark(line: Column) -> Column:
        return (
            F.when(line == "", F.lit(BLOCK_MARK))
            .when(is_heading(line), F.concat(F.lit(BLOCK_MARK), line, F.lit(HEAD_MARK)))
            .otherwise(F.regexp_replace(line, BULLET, ""))
        )

    def parts(block: Column) -> Column:
        head = F.when(block.contains(HEAD_MARK), F.substring_index(block, HEAD_MARK, 1))
        return F.struct(head.alias("head"), squeeze(F.substring_index(block, HEAD_MARK, -1)).alias("body"))

    def close(part: Column) -> Column:
        head, body = part["head"], part["body"]
        return F.when((body == "") | head.isNull(), body).otherwise(squeeze(F.concat_ws(" ", head, body)))

    def spaced(text: Column) -> Column:
        """Only spaces and line feeds are left of all white space."""
        plain = F.when(text.rlike(OTHER_SPACE), F.regexp_replace(text, OTHER_SPACE, " ")).otherwise(text)
        return F.replace(F.replace(plain, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))

    def sentences(text: Column) -> Column:
        lines = F.transform(F.split(text, "\n"), squeeze)
        blocks = F.split(F.array_join(F.transform(lines, mark), " "), BLOCK_MARK)
        closed = F.transform(F.transform(blocks, parts), close)
        # A pattern that is split at is compiled for each block, one that is replaced only once.
        return F.flatten(F.transform(closed, lambda b: F.split(F.regexp_replace(b, SENTENCE_GAP, f"$1{GAP_MARK}"), GAP_MARK)))

    def kept(text: Column) -> Column:
        whole = squeeze(F.replace(text, F.lit("\n"), F.lit(" ")))
        return let(whole, lambda full: F.filter(sentences(text), lambda s: (s != "") & (s != full) & ~is_heading(s)))

    def first_of_each(items: Column) -> Column:
        def firsts(keyed: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("string")), F.transform(keyed, lambda x: x["k"]))
            told = F.zip_with(keyed, before, lambda x, k: F.struct(x["i"].alias("i"), x["s"].alias("s"), x["k"].eqNullSafe(k).alias("again")))
            # The array of keys before is longer by one, which leaves an entry without a sentence.
            return F.sort_array(F.filter(told, lambda x: x["i"].isNotNull() & ~x["again"]))

        keyed = F.sort_array(F.transform(items, lambda s, i: F.struct(fold(s).alias("k"), i.alias("i"), s.alias("s"))))
        return F.transform(let(keyed, firsts), lambda x: x["s"])

    return let(let(let(F.coalesce(c, F.lit("")), spaced), kept), first_of_each)


UNIT = "array<struct<segment_type:string,segment_text:string>>"


def text_units(c: Column, mode: str) -> Column:
    """One ``full`` unit, followed by segments when there are at least two of them."""
    if mode not in ("full_description", "full_plus_segments"):
        raise ValueError(f"unknown segmentation mode: {mode}")

    def unit(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("segment_type"), value.alias("segment_text"))

    full = norm_ws(F.coalesce(c, F.lit("")))
    head = F.filter(F.array(unit("full", full)), lambda u: u["segment_text"] != "")
    if mode == "full_description":
        return head
    return let(
        semantic_segments(c),
        lambda segs: F.when(F.size(segs) <= 1, head).otherwise(
            F.concat(head, F.transform(segs, lambda s: unit("segment", s)))
        ),
    )


# ---------------------------------------------------------------- normal forms

def _ascii_letters() -> tuple[str, str, dict[str, str]]:
    """Characters of the BMP whose compatibility form is one ASCII character, and that character; all others that have an ASCII form, with it."""
    source, target, longer = [], [], {}
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1 and code <= 0xFFFF:
            source.append(char)
            target.append(plain)
        elif plain:
            longer[char] = plain
    return "".join(source), "".join(target), longer


def _char_class(chars) -> str:
    """A regular expression class of exactly these characters, as ranges."""
    codes = sorted(ord(c) for c in chars)
    spans = []
    for code in codes:
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


ACCENTED, PLAIN, LONGER = _ascii_letters()
HAS_LONGER = _char_class(LONGER)


def _spelled(c: Column) -> Column:
    """Ligatures, fractions, Roman numerals and the like replaced by the ASCII characters that they stand for."""
    forms = F.str_to_map(F.lit("\x01".join(f"{c}\x02{plain}" for c, plain in LONGER.items())), F.lit("\x01"), F.lit("\x02"))
    pieces = F.regexp_extract_all(c, F.lit(f"{HAS_LONGER}|[^{HAS_LONGER[1:-1]}]+"), 0)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(HAS_LONGER), F.try_element_at(forms, p)).otherwise(p)), "")


def to_ascii(c: Column) -> Column:
    """The ASCII part of the NFKD form: accents removed, ligatures and the like spelled out, other non-ASCII dropped."""
    text = F.coalesce(c, F.lit(""))
    # Most characters fail the first test of the look-ahead and never meet the long class.
    spelled = F.when(text.rlike(r"(?=[^\x00-\xBB])" + HAS_LONGER), _spelled(text)).otherwise(text)
    plain = F.regexp_replace(F.translate(spelled, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(plain)


def search_tokens(c: Column) -> Column:
    """Lower-case ``[a-z0-9]+`` runs of the ASCII form."""
    return F.regexp_extract_all(F.lower(to_ascii(c)), F.lit(r"[a-z0-9]+"), 0)


def ocr_norm(c: Column) -> Column:
    """Lower case, only letters, digits and underscore, single spaces."""
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return norm_ws(kept)


def ocr_tokens(c: Column) -> Column:
    return F.filter(F.split(ocr_norm(c), " "), lambda t: t != "")


def slug(c: Column, default: str = "etiqueta") -> Column:
    """Lower case, every run of other characters becomes one hyphen."""
    dashed = F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit(default))


def hex_color(c: Column, default: Column | str) -> Column:
    """Lower-cased ``#RRGGBB`` or the default."""
    raw = strip(c)
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.when(raw.rlike(r"^#[0-9A-Fa-f]{6}\z"), F.lower(raw)).otherwise(fallback)


def strict_hex_color(c: Column) -> Column:
    """Lower-cased ``#RRGGBB``; anything else fails the job."""
    raw = strip(c)
    return F.when(raw.rlike(r"^#[0-9A-Fa-f]{6}\z"), F.lower(raw)).otherwise(
        F.raise_error(F.concat(F.lit("invalid colour: "), F.coalesce(raw, F.lit("null")))).cast("string")
    )


def html_preview(c: Column, width: int = 160) -> Column:
    """Plain text of an HTML fragment, cut with an ellipsis beyond ``width``."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    text = norm_ws(F.regexp_replace(text, r"(?i)&nbsp;", " "))
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("…"))).otherwise(text)


def card_summary(brief: Column, html: Column, width: int = 160) -> Column:
    """The short description when there is one, else the preview of the long one."""
    short = F.coalesce(strip(brief), F.lit(""))
    cut = F.when(F.length(short) > width, F.concat(F.substring(short, 1, width - 3), F.lit("…"))).otherwise(short)
    return F.when(short != "", cut).otherwise(html_preview(html, width))


# Tags a note may keep; fixed by the note format.
NOTE_TAGS = "p|br|strong|b|em|i|u|s|ol|ul|li|a|h1|h2|h3|blockquote"


def strip_tags(c: Column, keep: str | None = None) -> Column:
    """Remove comments and tags, except those in the alternation ``keep``."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<!--.*?-->", "")
    names = rf"(?!/?(?:{keep})(?:[\s/>]))" if keep else ""
    return F.regexp_replace(text, rf"(?is)<{names}[/!?a-z][^>]*>", "")


# Where a link of a note may lead; fixed by the note format.
SAFE_TARGETS = r"(?i)^(?:https?://|mailto:|/|#)[^\x00-\x20]*$"
# Entities that a link target is freed of before it is judged, and which it gets again.
ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def _safe_link(attributes: Column) -> Column:
    """An opening link tag built anew, with its target if that is safe."""
    quoted = [F.regexp_extract(attributes, rf"(?is)(?:^|[\s/\"'])href\s*=\s*{form}", 1) for form in ('"([^"]*)"', "'([^']*)'", "([^\\s>\"']+)")]
    target = strip(F.coalesce(*[F.nullif(q, F.lit("")) for q in quoted], F.lit("")))
    for entity, sign in [("&apos;", "'"), ("&#039;", "'"), *ENTITIES]:
        target = F.replace(target, F.lit(entity), F.lit(sign))

    def tag(plain: Column) -> Column:
        # What is still an entity might hide anything; such a target is dropped.
        safe = plain.rlike(SAFE_TARGETS) & ~plain.rlike(r"&#|&\w+;")
        escaped = plain
        for entity, sign in reversed(ENTITIES):
            escaped = F.replace(escaped, F.lit(sign), F.lit(entity))
        return F.when(safe, F.concat(F.lit('<a href="'), escaped, F.lit('">'))).otherwise("<a>")

    return let(target, tag)


def clean_note(c: Column) -> Column:
    """Allow-listed tags, each written anew from its name; links keep a target that is safe.

    The text is cut into tags and text between. Other tags and comments go, an unclosed tag goes up to the next one,
    and a ``<`` that opens no tag is escaped.
    """
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<!--.*?(?:-->|\z)", "")
    piece = r"(?is)<[/!?a-z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[/!?a-z][^<]*|<|[^<]+"
    name = lambda p: F.lower(F.regexp_extract(p, rf"(?is)^</?({NOTE_TAGS})(?=[\s/>]).*>$", 1))

    def written(p: Column) -> Column:
        inside = F.regexp_extract(p, r"(?is)^<a([\s/].*)?>$", 1)
        return (
            F.when(~p.startswith("<"), p)
            .when(p == "<", F.lit("&lt;"))
            .when(name(p) == "", F.lit(""))
            .when(p.startswith("</"), F.concat(F.lit("</"), name(p), F.lit(">")))
            .when(name(p) == "a", _safe_link(inside))
            .otherwise(F.concat(F.lit("<"), name(p), F.lit(">")))
        )

    return strip(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(piece), 0), written), ""))


def note_is_empty(c: Column) -> Column:
    """True when nothing but white space and line breaks is left without tags."""
    text = strip_tags(c, "br")
    text = F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("&nbsp;"), F.lit(" "))
    return F.regexp_replace(text, r"(?U)\s+", "") == ""


# The mark of a fence, the words that may follow it, and the word after which a reply is a loop.
FENCE, FENCE_WORDS, LOOP_WORD = "```", ("json", "markdown"), "extra"


def _members(json: Column) -> Column:
    """Values of the top-level members of an object that are strings, of a repeated key the last one; null if it does not parse."""
    entries = F.map_entries(F.from_json(json, "map<string,variant>"))
    numbered = F.transform(entries, lambda m, i: F.struct(m["key"].alias("key"), m["value"].alias("value"), i.alias("at")))
    later = lambda m: F.exists(numbered, lambda n: (n["key"] == m["key"]) & (n["at"] > m["at"]))
    strings = F.filter(numbered, lambda m: (F.schema_of_variant(m["value"]) == "STRING") & ~later(m))
    return F.transform(strings, lambda m: F.variant_get(m["value"], "$", "string"))


def _quoted_values(broken: Column) -> Column:
    """Values of what looks like members: the text is cut at its quotation marks, and a piece is a value if a colon alone parts it from a key that is not empty.

    No mark is used twice, so the next key lies behind the mark that closes a value.
    """

    def read(pieces: Column) -> Column:
        start = F.struct(F.lit(-1).alias("used"), F.array().cast("array<string>").alias("values"))

        def step(seen: Column, at: Column) -> Column:
            value = (at - 2 >= seen["used"] + 2) & (F.element_at(pieces, at - 1) != "") & F.element_at(pieces, at).rlike(r"^\s*:\s*\z")
            return F.when(value, F.struct(at.alias("used"), F.array_append(seen["values"], F.element_at(pieces, at + 1)).alias("values"))).otherwise(seen)

        # Piece 0 has no mark before it and the last piece none behind it; element_at counts from 1.
        places = F.when(F.size(pieces) >= 5, F.sequence(F.lit(3), F.size(pieces) - 2)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step, lambda seen: seen["values"])

    return let(F.split(broken, '"'), read)


def clean_model_text(c: Column) -> Column:
    """Text out of a model reply: fences removed, JSON string values joined by newline; nothing of a reply that loops."""

    def without_fences(parts: Column) -> Column:
        word = rf"^(?:{'|'.join(FENCE_WORDS)})?\s*"
        inner = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.regexp_replace(p, word, ""))
        bare = strip(F.concat(F.element_at(parts, 1), F.array_join(inner, "")))
        looping = F.exists(F.slice(parts, 2, F.size(parts)), lambda p: p.rlike(rf"(?i)^markdown\s*{LOOP_WORD}"))
        return F.when(looping, F.lit("")).otherwise(let(bare, unpacked))

    def unpacked(text: Column) -> Column:
        filled = lambda values: F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: ~is_blank(v))
        members, quoted = filled(_members(text)), F.transform(filled(_quoted_values(text)), strip)
        found = F.when(F.size(members) > 0, members).otherwise(quoted)
        return F.when(text.startswith("{") & (F.size(found) > 0), F.array_join(found, "\n")).otherwise(text)

    return let(F.split(strip(F.coalesce(c, F.lit(""))), FENCE), without_fences)


# ---------------------------------------------------------------- predicates

# Fixed value: how a usable description starts.
GOOD_PREFIX = "Texto propio de la etiqueta:"


def is_failed_text(c: Column, prefix: str = GOOD_PREFIX, min_chars: int = 200) -> Column:
    """Blank, the word ERROR, too short, or not starting as a description must."""
    text = F.coalesce(strip(c), F.lit(""))
    return (text == "") | (text == "ERROR") | (F.length(text) < min_chars) | ~text.startswith(prefix)


def usable_ocr(c: Column) -> Column:
    """The recognised text, or null when it is blank or an error note."""
    return F.when(c.isNotNull() & (c != "") & ~c.startswith("[OCR"), c)


# Fixed value: the id format of evaluation items.
ITEM_ID = r"^[1-5]_(?:0[1-9]|10)\z"


def valid_id(c: Column, pattern: str = ITEM_ID) -> Column:
    return F.coalesce(strip(c).rlike(pattern), F.lit(False))


def canonical_id(c: Column, pattern: str = ITEM_ID) -> Column:
    """The stripped id; an id that breaks the pattern fails the job."""
    return F.when(valid_id(c, pattern), strip(c)).otherwise(
        F.raise_error(F.concat(F.lit("invalid id: "), F.coalesce(c, F.lit("null")))).cast("string")
    )


def natural_key(c: Column) -> list[Column]:
    """Sort keys that put ``item2`` before ``item10``."""
    number = F.try_to_number(F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")), F.lit("9" * 18))
    return [F.regexp_extract(c, r"^(\D*)", 1), number.cast(T.DecimalType(18, 0)), c]


def escape_like(c: Column) -> Column:
    """Backslash-escape the three special characters of LIKE."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


# ---------------------------------------------------------------- dates and short fields

def strict_date(c: Column) -> Column:
    """ISO date; blank is null, anything else that is not a real date fails the job."""
    raw = F.nullif(strip(c), F.lit(""))
    parsed = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(raw, "yyyy-MM-dd"))
    return F.when(raw.isNull(), F.lit(None).cast("date")).when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("invalid date: "), raw)).cast("date")
    )


def date_range_text(start: Column, end: Column) -> Column:
    """Caption of a period, empty when it is open on both ends."""
    a, b = F.date_format(start, "dd/MM/yyyy"), F.date_format(end, "dd/MM/yyyy")
    return (
        F.when(a.isNull() & b.isNull(), F.lit(""))
        .when(b.isNull(), F.concat(F.lit("Desde "), a))
        .when(a.isNull(), F.concat(F.lit("Hasta "), b))
        .otherwise(F.concat(F.lit("Del "), a, F.lit(" al "), b))
    )


def action_for(method: Column, path: Column) -> Column:
    """Name of a logged action; paths and names are fixed values."""
    return (
        F.when(path == "/auth/me", "session_validate")
        .when(path == "/auth/refresh", "session_refresh")
        .when(path.startswith("/admin/"), "admin_request")
        .when(method != "GET", "data_change")
        .otherwise("api_request")
    )


# The keys kept of what a client reports about itself, and the field limits of the log.
CLIENT_KEYS = ["source", "timezone", "language", "platform", "screen"]
LOG_LIMITS = {"user_email": 255, "action": 80, "path": 255, "user_agent": 512}


def client_details(c: Column) -> Column:
    """JSON of the non-blank known keys with plain values, each cut at 120 characters, or null."""
    read = lambda kind: F.from_json(c, T.StructType([T.StructField(k, kind) for k in CLIENT_KEYS]))
    parsed, objects, lists = read(T.StringType()), read(T.MapType(T.StringType(), T.StringType())), read(T.ArrayType(T.StringType()))
    plain = {k: F.when(objects[k].isNull() & lists[k].isNull(), strip(parsed[k])) for k in CLIENT_KEYS}
    fields = [F.substring(F.nullif(plain[k], F.lit("")), 1, 120).alias(k) for k in CLIENT_KEYS]
    return F.nullif(F.to_json(F.struct(*fields)), F.lit("{}"))


def truncate_fields(df, limits: dict[str, int] = LOG_LIMITS):
    """Cut the named string columns at their field length."""
    return df.withColumns({n: F.substring(F.col(n), 1, w) for n, w in limits.items() if n in df.columns})


def progress(base: Column, weight: Column, elapsed: Column, ratio: Column, size_mb: Column) -> Column:
    """Progress within a phase; a phase without a known ratio is taken at 6 seconds per MB."""
    estimate = F.coalesce(ratio, F.lit(6.0)) * size_mb
    share = F.when(estimate > 0, F.least(F.lit(1.0), elapsed / estimate)).otherwise(F.lit(1.0))
    return base + share * weight
