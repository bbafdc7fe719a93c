"""Rules over texts as Column expressions: quality checks, redaction, caps and rewriting.

A null text stays null in what rewrites it, and counts as empty in what checks it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
COORDINATE_PAIR = r"-?\d{1,3}\.\d{4,}\s*,\s*-?\d{1,3}\.\d{4,}"
PERCENT = r"(?<![~<\d.])(\d+(?:\.\d+)?)%"
CENTRED_NEAR = r"(?i)centered near\s+[-+]?\d+(?:\.\d+)?°\s*,\s*[-+]?\d+(?:\.\d+)?°\.?"
ISO_COUNTRY = r"(?i)\bISO country:\s*[A-Z]{2}\.?"
VICINITY = r"(?i)\bVicinity:\s*[^.\n]{1,200}\.?"
COORDINATE_WORD = r"(?i)\b(latitude|longitude|coordinates_wgs84)\b"
BASE_ID = r"^(poi_\d+)"
TILE_SUFFIX = r"_t\d{4,}$"
OPENERS = [
    r"^\s*this\s+sector\s+(?:offers|presents|reveals|shows|provides)\b",
    r"^\s*the\s+sector\s+(?:offers|presents|reveals|shows|provides)\b",
    r"^\s*here\s+you\s+(?:can|will)\s+see\b",
    r"^\s*in\s+this\s+sector\b",
]
PHRASES = [
    r"\bperfect\s+for\s+(?:those|players|anyone|visitors|tourists)\b",
    r"\bideal\s+for\s+(?:players|those|anyone)\b",
    r"\bgreat\s+for\s+(?:players|those|anyone)\b",
    r"\bbeautiful\s+(?:scenery|landscape|view)\b",
    r"\bserene\s+(?:atmosphere|environment|setting)\b",
    r"\btranquil\s+(?:atmosphere|landscape|setting)\b",
    r"\btake\s+your\s+time\s+to\s+explore\b",
    r"\bclear\s+understanding\s+of\s+this\s+zone\b",
]
CLUSTER = [r"\boffers\b", r"\bglimpse\b", r"\b(?:landscape|environment|setting)\b"]
CLUSTER_CODE = "brochure_cluster_offers_glimpse_landscape"
# Lengths of the hint tiers at most.
TIER_LENGTHS = [220, 260, 280, 220, 180, 220]
# How labels read in prose.
READABLE_LABELS = {
    "bare_ground": "bare ground",
    "built": "built areas",
    "crops": "cropland",
    "flooded_vegetation": "flooded vegetation",
    "grass": "grassland",
    "shrub_and_scrub": "shrub and scrub",
    "snow_and_ice": "snow and ice",
    "trees": "tree cover",
    "water": "water",
}
# What must not be in training texts.
BLOAT = ["_inputs", "_internal_coords", "npz_base64", "inline_base64", "decoder_attention_mask", "engine.patch_diagnostics"]
# Requests for another try, by violation.
ADVICE = {
    "too_short": "write at least two full sentences",
    "banned_opener": "do not begin with 'This sector…', 'The sector…', 'Here you can see…', or 'In this sector…'",
    "banned_phrase": "avoid brochure phrases like 'perfect for players', 'ideal for', 'serene atmosphere', 'take your time to explore'",
    CLUSTER_CODE: "avoid stacking 'offers', 'glimpse', and 'landscape/environment' in one blurb",
}


def _list(codes: Iterable[Column]) -> Column:
    return F.array_compact(F.array(*codes))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _literal(pattern: str) -> str:
    """The longest run of letters that every match of a pattern holds, or nothing."""
    bare = re.sub(r"\([^)]*\)|\\.", " ", pattern)
    return max(re.findall(r"[a-z]+", bare), key=len, default="")


def _fits(text: Column, low: Column, pattern: str, flags: str) -> Column:
    """Whether a pattern fits somewhere; the search is left out where a word that every match holds isn't in the text."""
    found = text.rlike(f"(?{flags}){pattern}")
    return (low.contains(_literal(pattern)) & found) if _literal(pattern) else found


def has_coordinates(text: Column) -> Column:
    """Whether two numbers with four decimals or more stand side by side."""
    return F.coalesce(text.rlike(COORDINATE_PAIR), F.lit(False))


def first_banned(text: Column, banned: list[str]) -> Column:
    """The first of the banned strings in text, in any case, or null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(b.lower()), F.lit(b)) for b in banned if b], F.lit(None).cast("string"))


def caption_violations(text: Column, *, most: int = 400, banned: list[str] | None = None) -> Column:
    """Codes of the rules that a caption breaks, in a fixed order."""
    return _list([
        F.when(F.length(text) > most, F.lit("length_cap")),
        F.when(has_coordinates(text), F.lit("coordinate_literal")),
        *([F.when(first_banned(text, banned).isNotNull(), F.lit("banned_substring"))] if banned else []),
    ])


def style_violations(text: Column) -> Column:
    """Codes of style faults: too short, the first stock opener, every stock phrase, the cluster."""

    def codes(x: Column) -> Column:
        t, low = x["t"], x["low"]
        opener = F.coalesce(*[F.when(_fits(t, low, p, "im"), F.lit(f"banned_opener_{i}")) for i, p in enumerate(OPENERS)])
        cluster = F.lit(True)
        for p in CLUSTER:
            cluster = cluster & _fits(t, low, p, "i")
        return _list([
            F.when(F.length(t) < 40, F.lit("too_short")),
            opener,
            *[F.when(_fits(t, low, p, "i"), F.lit(f"banned_phrase_{i}")) for i, p in enumerate(PHRASES)],
            F.when(cluster, F.lit(CLUSTER_CODE)),
        ])

    whole = F.trim(F.coalesce(text, F.lit("")))
    return let(F.struct(whole.alias("t"), F.lower(whole).alias("low")), codes)


def should_retry(violations: Column) -> Column:
    """Whether another try is worth its cost: a bad opener, too short, two phrases, or the cluster and a phrase."""
    phrases = F.size(F.filter(violations, lambda v: v.startswith("banned_phrase_")))
    return (
        F.exists(violations, lambda v: v.startswith("banned_opener_"))
        | F.array_contains(violations, "too_short")
        | (phrases >= 2)
        | (F.array_contains(violations, CLUSTER_CODE) & (phrases >= 1))
    )


def style_rank(text: Column) -> Column:
    """struct by which the better of two candidates is the larger: no bad opener, then fewer violations."""
    return let(style_violations(text), lambda v: F.struct((~F.exists(v, lambda x: x.startswith("banned_opener_"))).cast("int").alias("opener_ok"), (-F.size(v)).alias("fewer")))


def retry_advice(violations: Column) -> Column:
    """What to ask for in another try, for the first six violations, without repetition; empty without any."""
    kind = F.transform(F.slice(violations, 1, 6), lambda v: F.regexp_replace(v, r"^(banned_(?:opener|phrase))_\d+$", "$1"))
    table = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return F.array_join(F.array_distinct(F.transform(kind, lambda k: F.coalesce(F.try_element_at(table, k), k))), "; ")


def quantised_percent(number: Column, step: int = 5) -> Column:
    """A percentage as a coarse band: <1%, ~2%, or the nearest step from step to 100 (halves to even)."""
    v = number.try_cast("double")
    near = F.greatest(F.lit(step), F.least(F.lit(100), (F.bround(v / step) * step).cast("int")))
    return F.when(v < 1, F.lit("<1%")).when(v < 3, F.lit("~2%")).when(v.isNotNull(), F.concat(F.lit("~"), near.cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("~"), number.cast("string"), F.lit("%")))


def coarse_percentages(text: Column) -> Column:
    """struct(text, n): every exact percentage as its band.

    The text is cut at the numbers and put together again, all in one expression: pieces between are what
    remains when numbers are the separators.
    """
    def put_together(x: Column) -> Column:
        joined = F.array_join(F.zip_with(F.split(x["text"], PERCENT, -1), x["numbers"], lambda p, n: F.concat(F.coalesce(p, F.lit("")), F.coalesce(quantised_percent(n), F.lit("")))), "")
        return F.struct(F.when(F.size(x["numbers"]) > 0, joined).otherwise(x["text"]).alias("text"), F.size(x["numbers"]).alias("n"))

    return let(F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(PERCENT), F.lit(1)).alias("numbers")), put_together)


def redacted_places(text: Column) -> Column:
    """struct(text, n): without coordinates, country tags and vicinities; n is how many of the three kinds occurred."""
    def step(before: Column, pattern: str, to: str) -> Column:
        both = let(before, lambda x: F.struct(x.alias("x"), F.regexp_replace(x["text"], pattern, to).alias("new")))
        return let(both, lambda y: F.struct(y["new"].alias("text"), (y["x"]["n"] + (y["new"] != y["x"]["text"]).cast("int")).alias("n")))

    out = F.struct(text.alias("text"), F.lit(0).alias("n"))
    for pattern, to in ((CENTRED_NEAR, "centered near an unspecified location."), (ISO_COUNTRY, ""), (VICINITY, "")):
        out = step(out, pattern, to)
    return out


def redacted_blob(text: Column, label: str) -> Column:
    """Text with the JSON block that follows a list item labelled so, up to its task line, replaced by a note."""
    return F.regexp_replace(text, rf"(?is)(- {re.escape(label)}.*?:)\s*\{{.*?\}}\s*\n\s*\nTask:", "$1\n<omitted>\n\nTask:")


def minified_json(text: Column) -> Column:
    """A JSON text without spaces between its parts and with its keys in order; other texts stay."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def trimmed(text: Column, most: int) -> Column:
    """Text of at most so many characters, cut after the last end of a sentence, with a mark.

    An end is white space that stands before a mark of a sentence's end, as in the data to match: the search
    runs over the reversed text.
    """
    def kept(x: Column) -> Column:
        return F.when(x["back"] > 0, F.substring(x["cut"], F.lit(1), F.length(x["cut"]) - x["back"] + 1)).otherwise(x["cut"])

    cut = let(F.substring(text, 1, most - 1), lambda c: F.struct(c.alias("cut"), F.regexp_instr(F.reverse(c), F.lit(r"[.!?]\s")).alias("back")))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(let(cut, kept), r"\s+$", ""), F.lit("\n\n[trimmed]")))


def normalised_text(text: Column, most: int) -> Column:
    """struct(text, location_redacted, percent_deprecision, assistant_trimmed, coord_kw_remaining): the whole chain in order."""
    def all_of(x: Column) -> Column:
        return F.struct(
            x["done"].alias("text"),
            x["places"].alias("location_redacted"),
            x["percents"]["n"].alias("percent_deprecision"),
            (F.length(x["percents"]["text"]) > most).cast("int").alias("assistant_trimmed"),
            x["done"].rlike(COORDINATE_WORD).cast("int").alias("coord_kw_remaining"),
        )

    places = let(redacted_places(text), lambda p: F.struct(p["n"].alias("places"), coarse_percentages(p["text"]).alias("percents")))
    return let(let(places, lambda x: F.struct(x["places"].alias("places"), x["percents"].alias("percents"), trimmed(x["percents"]["text"], most).alias("done"))), all_of)


def readable_labels(text: Column) -> Column:
    """Text with class names as they read in prose."""
    for raw, pretty in READABLE_LABELS.items():
        text = F.regexp_replace(text, rf"\b{raw}\b", pretty)
    return text


def without_markdown(text: Column) -> Column:
    """Text without emphasis, inline code marks and bullets."""
    plain = F.regexp_replace(text, r"(\*\*|__)(.*?)\1", "$2")
    plain = F.regexp_replace(plain, r"`([^`]+)`", "$1")
    return F.regexp_replace(plain, r"(?m)^\s*[-*]\s+", "")


def plain_prose(text: Column) -> Column:
    """Text without fences, rules, headings, emphasis, code and bullets, and with single spaces; null as empty."""
    steps = [
        (r"```[^\n`]*\n([\s\S]*?)```", "$1"),
        (r"```([\s\S]*?)```", "$1"),
        (r"(?m)^\s*-{3,}\s*$", ""),
        (r"\s-{3,}\s", " "),
        (r"(?m)^#+\s*", ""),
        (r"\*\*([\s\S]*?)\*\*", "$1"),
        (r"__([\s\S]*?)__", "$1"),
        (r"(?<!\*)\*(?!\*)([^*\n]+)\*(?!\*)", "$1"),
        (r"`([^`]*)`", "$1"),
        (r"(?m)^\s*[-*]\s+", ""),
        (r"[ \t]{2,}", " "),
        (r"\n{3,}", "\n\n"),
    ]
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def replaced(text: Column, table: list[tuple[str, str]], *, any_case: bool = False) -> Column:
    """Text after literal replacements in order."""
    for old, new in table:
        text = F.regexp_replace(text, f"(?i){re.escape(old)}", new.replace("\\", "\\\\").replace("$", "\\$")) if any_case else F.replace(text, F.lit(old), F.lit(new))
    return text


def capped(text: Column, most: int) -> Column:
    """Text of at most so many characters, the last an ellipsis if it was longer."""
    t = F.trim(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def titled(address: Column, fallback: Column, most: int = 120) -> Column:
    """An address, shortened by three dots beyond so many characters, or else the fallback."""
    t = F.trim(address)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).when(F.length(t) > 0, t).otherwise(fallback)


def cut_at_boundary(text: Column, most: int) -> Column:
    """Text of about so many characters: cut after the last sentence, else the last word, if that keeps a third."""
    third = most // 3

    def cut(x: Column) -> Column:
        window, back = x["window"], x["back"]
        ends = [F.when(F.instr(back, m[::-1]) > 0, F.length(window) - F.instr(back, m[::-1]) - len(m) + 1).otherwise(-1) for m in (". ", ".\n", "? ", "! ", "\n\n")]
        space = F.when(F.instr(back, " ") > 0, F.length(window) - F.instr(back, " ")).otherwise(-1)
        return let(F.struct(F.greatest(*ends).alias("at"), space.alias("space")), lambda p: F.when(p["at"] >= third, p["at"]).when(p["space"] > third, p["space"]).otherwise(most - 1))

    def short(x: Column) -> Column:
        out = F.regexp_replace(F.substring(x["t"], F.lit(1), cut(x) + 1), r"^\s+|\s+$", "")
        return let(out, lambda o: F.when(F.length(o) < F.length(x["t"]), F.concat(F.regexp_replace(o, r"[.,; ]+$", ""), F.lit("…"))).otherwise(o))

    def whole(x: Column) -> Column:
        return F.when(F.length(x["t"]) <= most, x["t"]).otherwise(F.regexp_replace(x["window"], r"\s+$", "") if most < 32 else short(x))

    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    parts = let(let(t, lambda t: F.struct(t.alias("t"), F.substring(t, 1, most).alias("window"))), lambda x: F.struct(x["t"].alias("t"), x["window"].alias("window"), F.reverse(x["window"]).alias("back")))
    return let(parts, whole)


def leading_sentences(text: Column, most: int, sentences: int = 4) -> Column:
    """The leading sentences, so many at most, that fit; if not even one does, a cut at a boundary."""

    def fitting(t: Column) -> Column:
        return F.aggregate(
            F.slice(F.split(t, r"(?<=[.!?])\s+"), 1, sentences),
            F.struct(F.lit("").alias("s"), F.lit(False).alias("over")),
            lambda acc, p: let(
                F.concat_ws(" ", F.nullif(acc["s"], F.lit("")), p),
                lambda both: F.when(acc["over"] | (F.length(F.trim(both)) > most), F.struct(acc["s"].alias("s"), F.lit(True).alias("over"))).otherwise(F.struct(both.alias("s"), F.lit(False).alias("over"))),
            ),
            lambda acc: acc["s"],
        )

    def whole(t: Column) -> Column:
        return F.when(F.length(t) <= most, t).otherwise(let(fitting(t), lambda fit: F.when(fit != "", fit).otherwise(cut_at_boundary(t, most))))

    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), whole)


def base_id(stem: Column) -> Column:
    """The id before any suffix, or the stem itself."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(stem), BASE_ID, 1), F.lit("")), stem)


def lookup_stem(stem: Column) -> Column:
    """The stem without its tile suffix."""
    return F.regexp_replace(F.trim(stem), TILE_SUFFIX, "")


def safe_filename(name: Column, most: int = 200) -> Column:
    out = F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), 1, most)
    return F.when(F.length(out) > 0, out).otherwise(F.lit("row"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def matched_terms(text: Column, terms: list[str]) -> Column:
    """Those of the terms that stand in text as whole words, in any case; spaces match any white space."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for term in (x.strip().lower() for x in terms):
        if term:
            body = r"\s+".join(re.escape(w) for w in term.split())
            found.append(F.when(low.rlike(rf"(?<![a-z0-9]){body}(?![a-z0-9])"), F.lit(term)))
    return _list(found) if found else F.array().cast("array<string>")


def filled(template: str, facts: Column, most: int) -> Column:
    """A template with {names} replaced from a map, unknown ones by nothing, at most so long."""
    out: list[Column] = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        out.append(F.coalesce(F.try_element_at(facts, F.lit(part)), F.lit("")) if i % 2 else F.lit(part))
    return capped(F.concat(*out), most)


def sql_literal(text: Column) -> Column:
    """Text with its quotes doubled."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def usable(*values: Column) -> Column:
    """The first value that is neither null, blank nor -99."""
    return F.coalesce(*[F.when(~F.trim(v).isin("", "-99"), F.trim(v)) for v in values])


def error_class(message: Column) -> Column:
    """A code for an error message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(low.contains("timeout") | low.contains("timed out"), F.lit("timeout"))
        .when(low.contains("connect"), F.lit("connection"))
        .when(low.rlike(r"\b(401|403)\b"), F.lit("auth"))
        .when(low.rlike(r"\b5\d\d\b"), F.lit("upstream"))
        .otherwise(F.lit("internal"))
    )


def path_candidates(path: Column) -> Column:
    """Places to look for a path in: for NS__NAME/rest also NS/NAME/rest and rest, in that order."""
    ns, name, rest = (F.regexp_extract(path, r"^([^/]+?)__([^/]+)/(.+)$", i) for i in (1, 2, 3))
    return F.when(ns != "", F.array(path, F.concat_ws("/", ns, name, rest), rest)).otherwise(F.array(path))


def namespaced(path: Column, tag: str, prefixes: tuple[str, ...] = ("images/", "stills/", "analysis_images/")) -> Column:
    """A relative media path with a tag behind its first folder; once only."""
    clean = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    out = F.when(F.lit(False), path)
    for p in prefixes:
        rest = F.substring(clean, F.lit(len(p) + 1), F.length(clean))
        out = out.when(clean.startswith(p), F.when(rest.startswith(f"{tag}/"), clean).otherwise(F.concat(F.lit(f"{p}{tag}/"), rest)))
    return out.otherwise(path)


def split_of(identifier: Column, buckets: int = 10) -> Column:
    """train, validation or test by the first 64 bits of the id's SHA-256: eight, one and one of ten buckets."""
    bucket = F.conv(F.substring(F.sha2(identifier.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)") % buckets
    return F.when(bucket <= 7, F.lit("train")).when(bucket == 8, F.lit("validation")).when(bucket.isNotNull(), F.lit("test"))


def canonical_key(**parts: Column) -> Column:
    """SHA-256 over the parts as compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)


def etag(document: Column) -> Column:
    """A weak tag of a document's bytes."""
    return F.concat(F.lit('W/"'), F.substring(F.sha2(document, 256), 1, 24), F.lit('"'))
