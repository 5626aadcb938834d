"""Ids, names, dates and texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.params import BAD_NAMES, MODEL_LABELS, NO_NAMES


def entity_id(name: Column, upper: bool = False) -> Column:
    """`Entity-` and ten hex digits of the name's md5; blank names have none. upper: the other id space."""
    key = F.trim(name)
    key = F.upper(key) if upper else F.lower(key)
    return F.when(F.trim(name) != "", F.concat(F.lit("Entity-"), F.substring(F.md5(key), 1, 10)))


def relation_id(source: Column, target: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, "^Entity-", "")
    return F.concat(F.lit("Relation-"), bare(source), F.lit("-"), bare(target))


def normal_date(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as YYYY-MM-DD, missing parts 01; the day is checked against 31 only; else empty."""
    form = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(F.trim(text), form, k), F.lit("")), F.lit("01"))
    good = F.trim(text).rlike(form) & part(2).between("01", "12") & part(3).between("01", "31")
    return F.when(good, F.concat_ws("-", F.regexp_extract(F.trim(text), form, 1), part(2), part(3))).otherwise("")


def publication_year(text: Column, now: int) -> Column:
    """The first word as a year from 1900 to now, or null."""
    year = F.split(F.trim(text), r"[\s-]")[0].try_cast("int")
    return F.when(year.between(1900, now), year)


def pmid(value: Column) -> Column:
    """A number as its integer's text; anything else empty."""
    return F.coalesce(value.try_cast("double").try_cast("bigint").cast("string"), F.lit(""))


def clean(text: Column) -> Column:
    """Commas to semicolons, no quotes, newlines to spaces, trimmed."""
    return F.trim(F.translate(text, ",\n\"'", "; "))


def strict_clean(text: Column) -> Column:
    """clean() without leading non-word characters; null if only digits and symbols are left."""
    bare = F.ltrim(F.regexp_replace(clean(text), r"(?U)^[^\w]+", ""))
    return F.when((bare != "") & ~bare.rlike(r"(?U)^[\d\W_]+$"), bare)


def source_file(name: Column, prefix: str = "") -> Column:
    """`{prefix}x__y__std.csv` as `x__y`; a path as its file name."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"__std\.csv$", "")
    return F.when(bare.startswith(prefix), F.substr(bare, F.lit(len(prefix) + 1))).otherwise(bare) if prefix else bare


def source_label(name: Column, prefix: str = "") -> Column:
    """The first part of source_file(), capitalised, with `_` for characters of no word."""
    base = F.regexp_replace(F.substring_index(source_file(name, prefix), "__", 1), r"(?U)[^\w]", "_")
    return F.concat(F.upper(F.substring(base, 1, 1)), F.lower(F.substr(base, F.lit(2))))


def evidence_in(evidence: Column, text: Column) -> Column:
    """Whether the text has the evidence, both lower-cased and without symbols; empty evidence is in any."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))
    return bare(text).contains(bare(evidence))


def covering_sentences(text: Column, offsets: Column) -> Column:
    """The sentences that hold one of the offsets (array of start and end, from 0, end exclusive) whole, joined by spaces.

    Where none does, the sentence that starts nearest to the first offset, of equally near ones the first; null without
    text or offsets. A sentence ends at `.`, `!` or `?` before white space.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s).+?(?:(?<=[.!?])\s+|$)"), F.lit(0))
    first = F.get(offsets, 0)["start"].cast("long")

    def step(state: Column, piece: Column) -> Column:
        at = state["at"] + F.length(piece) - F.length(F.regexp_replace(piece, r"^\s+", ""))
        body = F.regexp_replace(piece, r"^\s+|\s+$", "")
        holds = F.exists(offsets, lambda o: (o["start"] >= at) & (o["end"] <= at + F.length(body)))
        found = F.when(holds, F.concat(state["found"], F.array(body))).otherwise(state["found"])
        far = F.abs(first - at)
        nearer = state["far"].isNull() | (far < state["far"])
        return F.struct(
            (state["at"] + F.length(piece)).alias("at"), found.alias("found"),
            F.when(nearer, far).otherwise(state["far"]).alias("far"), F.when(nearer, body).otherwise(state["near"]).alias("near"),
        )

    start = F.expr("named_struct('at', 0L, 'found', CAST(array() AS array<string>), 'far', CAST(NULL AS bigint), 'near', CAST(NULL AS string))")
    return F.aggregate(pieces, start, step, lambda s: F.when(F.size(s["found"]) > 0, F.array_join(s["found"], " ")).when(first.isNotNull(), s["near"]))


def first_sentence(text: Column, needle: Column) -> Column:
    """The first sentence with the needle, in any case; null if none has it."""
    found = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.instr(F.lower(s), F.lower(needle)) > 0)
    return F.get(found, 0)


def normal_name(name: Column) -> Column:
    """Lower case, single spaces, no symbols at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "), r"(?U)^[\W_]+|[\W_]+$", "")


def fingerprint(text: Column) -> Column:
    """sha1 of the lower-cased text's word characters."""
    return F.sha1(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+", ""))


# What is left out of names or spelled otherwise, and the two forms of bracketed parts.
ALLELE = r"(?i)\b(wt|wild[-\s]*type)\s*allele\b"
ALLELE_OF_ENTITY = r"(?i)\b(?:wt|wild[-\s]?type)\s*allele\b"
GREEK = {"α": "alpha", "β": "beta"}
DASHES = "‐‑‒–—―"
EDGE_SIGNS = " \t\r\n,;:()[]{}"
LAST_BRACKET = r"^(.*?)\s*\(([^)]+)\)\s*$"
ANY_BRACKET = r"\((.*?)\)"


def match_name(name: Column) -> Column:
    """A name as its words, without allele suffixes, Greek letters spelled and all dashes alike."""
    plain = F.translate(F.regexp_replace(name, ALLELE, " "), DASHES, "-" * len(DASHES))
    for letter, word in GREEK.items():
        plain = F.replace(plain, F.lit(letter), F.lit(word))
    return F.array_join(F.filter(F.split(plain, r"\s+"), lambda w: w != ""), " ")


def match_key(name: Column) -> Column:
    return F.regexp_replace(F.upper(match_name(name)), r"[\s_]+", "")


def clean_entity_name(name: Column) -> Column:
    """An entity's name without allele suffixes, runs of white space and signs at its ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(name, ALLELE_OF_ENTITY, ""), r"\s{2,}", " "), F.lit(EDGE_SIGNS))


def bad_name(name: Column) -> Column:
    """Whether a name says nothing: listed (also as a plural), too short or long, or symbols alone."""
    s = F.lower(F.trim(name))
    return F.coalesce(s.isin(BAD_NAMES) | F.rtrim(s, F.lit("s")).isin(BAD_NAMES) | ~F.length(s).between(2, 60) | s.rlike(r"(?U)^[\W_]+$") | s.isin(NO_NAMES), F.lit(True))


def pg_array(items: Column) -> Column:
    """An array of strings as a PostgreSQL array literal."""
    quoted = F.transform(items, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def abbreviation(text: Column) -> Column:
    """Whether a bracketed text looks like an abbreviation: a letter, or two to eight characters, half of them letters."""
    letters, digits = F.length(F.regexp_replace(text, r"(?U)\P{L}", "")), F.length(F.regexp_replace(text, r"\D", ""))
    n = F.length(text)
    return ((n == 1) & (letters == 1)) | (n.between(2, 8) & (letters > 0) & (digits < n) & (2 * letters >= n))


def bracket_parts(entity: Column) -> Column:
    """struct(main_text, details: array of (content, type)) of a name with bracketed parts.

    A last bracket alone is cut off; otherwise all brackets are. Nothing is cut without brackets.
    """
    last = entity.rlike(LAST_BRACKET)
    found = F.when(last, F.array(F.regexp_extract(entity, LAST_BRACKET, 2))).otherwise(F.regexp_extract_all(entity, F.lit(ANY_BRACKET), F.lit(1)))
    rest = F.trim(F.when(last, F.regexp_extract(entity, LAST_BRACKET, 1)).when(entity.contains("("), F.regexp_replace(entity, ANY_BRACKET, "")))
    kind = lambda c: F.when(abbreviation(c), "abbreviation").otherwise("info")
    details = F.transform(found, lambda x: F.struct(F.trim(x).alias("content"), kind(F.trim(x)).alias("type")))
    return F.struct(F.coalesce(F.nullif(rest, F.lit("")), entity).alias("main_text"), details.alias("details"))


def key_values(text: Column) -> Column:
    """`[Key: value]` groups as a map; of a repeated key the last."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^:\]]+:[^\]]*)\]"), F.lit(1)), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["k"] == x["k"])))


def json_payload(text: Column) -> Column:
    """The JSON in a fenced block, or the text itself."""
    fenced = F.regexp_extract(text, r"(?is)```json\s*(.*?)\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(text)


def pub_date(text: Column) -> Column:
    """The first two numbers as `year-month`, the second two digits long or 01; without a number empty."""
    numbers = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))
    month = F.coalesce(F.get(numbers, 1), F.lit("01"))
    return F.when(F.size(numbers) > 0, F.concat(F.get(numbers, 0), F.lit("-"), F.when(F.length(month) < 2, F.lpad(month, 2, "0")).otherwise(month))).otherwise("")


def first_issn(text: Column) -> Column:
    """The first word of a field with a dash; other fields as they are."""
    return F.when(text.contains("-"), F.split(F.trim(text), r"\s+")[0]).otherwise(text)


def model_label(name: Column) -> Column:
    """A model's short label; OtherModel if it isn't listed, UnknownModel if there is none."""
    listed = F.create_map(*(F.lit(x) for kv in MODEL_LABELS.items() for x in kv))
    return F.when(name.isNull(), "UnknownModel").otherwise(F.coalesce(F.try_element_at(listed, name), F.lit("OtherModel")))


def gold_meta(text: Column) -> dict[str, Column]:
    """pmid, title and body of `pmid:title:body`; a text of fewer parts is all body."""
    parts = F.split(text, ":", 3)
    whole = F.size(parts) == 3
    digits = F.nullif(F.regexp_extract(parts[0], r"\d+", 0), F.lit(""))
    return {"pmid": F.when(whole, digits), "title": F.when(whole, F.get(parts, 1)).otherwise(""), "body": F.when(whole, F.get(parts, 2)).otherwise(text)}


def safe_slice(text: Column, start: Column, stop: Column) -> Column:
    """text from start to stop, in whichever order, within its bounds; without both empty."""
    a, b = F.greatest(F.least(start, stop), F.lit(0)), F.least(F.greatest(start, stop), F.length(text))
    out = F.substr(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    return F.when(start.isNotNull() & stop.isNotNull(), out).otherwise("")
