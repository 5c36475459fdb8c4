"""Texts: previews, tokens, similarity, paths and labels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of words that contradict each other.
ANTONYMS = (
    ("buy", "sell"), ("long", "short"), ("bullish", "bearish"), ("increase", "decrease"), ("up", "down"),
    ("positive", "negative"), ("profitable", "unprofitable"), ("win", "loss"), ("good", "bad"), ("should", "shouldn't"),
    ("always", "never"), ("yes", "no"), ("support", "resistance"), ("overbought", "oversold"), ("truth", "false"),
    ("correct", "incorrect"), ("above", "below"), ("high", "low"), ("rise", "fall"), ("gain", "loss"),
    ("upward", "downward"), ("strong", "weak"), ("overweight", "underweight"), ("exceed", "underperform"), ("better", "worse"),
    ("improve", "decline"), ("buying", "selling"), ("bull", "bear"), ("overvalued", "undervalued"), ("expensive", "cheap"),
)
_SPACE = "[ \\t\\r\\n]+"


def preview(text: Column, size: int) -> Column:
    """The first ``size`` characters with an ellipsis after them if more follow."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def preview_within(text: Column, size: int) -> Column:
    """As ``preview``, but one character is given up for the ellipsis."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("..."))).otherwise(text)


def words(text: Column) -> Column:
    """Words between blanks, tabs and line ends."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays taken as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each lower-case alphanumeric word, two blanks before it and one after."""
    clean = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(F.array_distinct(clean), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all; 0 if neither has any."""
    left, right = trigrams(a), trigrams(b)
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def token_estimate(text: Column) -> Column:
    """Tokens to expect of a text: three words make four."""
    return F.round(F.size(words(text)) / 0.75).cast("long")


def pieces(text: Column, size: int = 4000) -> Column:
    """Consecutive pieces of ``size`` characters; none of an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def contradiction_signals(a: Column, b: Column, pairs=ANTONYMS) -> Column:
    """Pairs of opposites that stand on different sides, found as parts of words too."""
    a, b = F.lower(a), F.lower(b)
    hit = [((a.contains(x) & b.contains(y)) | (a.contains(y) & b.contains(x))).cast("int") for x, y in pairs]
    return reduce(lambda s, h: s + h, hit)


def _finder(pairs):
    """An automaton that finds all words of the pairs in one pass; each word has its bits on either side."""
    import ahocorasick

    bits: dict[str, list[int]] = {}
    for k, pair in enumerate(pairs):
        for side, word in enumerate(pair):
            bits.setdefault(word, [0, 0])[side] |= 1 << k
    found = ahocorasick.Automaton()
    for word, masks in bits.items():
        found.add_word(word, tuple(masks))
    found.make_automaton()
    return found


def with_opposites(rows: DataFrame, text_col: str, pairs=ANTONYMS) -> DataFrame:
    """The rows with ``left_words`` and ``right_words``: a bit for each pair whose first, or second, word stands in the text, as part of a word too.

    Each text is gone through once, for all words together; what two texts say
    against each other is then a count of bits. A null text holds no word.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("left_words", T.LongType()), T.StructField("right_words", T.LongType())])
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(pairs)
        for batch in batches:
            sides: tuple[list, list] = ([], [])
            texts = batch.column(at)
            for k in range(batch.num_rows):
                text, left, right = texts[k].as_py(), 0, 0
                for masks in {m for _, m in finder.iter(text.lower())} if text else ():
                    left, right = left | masks[0], right | masks[1]
                for side, mask in zip(sides, (left, right), strict=True):
                    side.append(mask)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s, pa.int64()) for s in sides)], names=schema.names)

    return rows.mapInArrow(run, schema)


def opposite_signals(left_a: Column, right_a: Column, left_b: Column, right_b: Column) -> Column:
    """What ``contradiction_signals`` counts, from the bits of two texts."""
    return F.bit_count(left_a.bitwiseAND(right_b).bitwiseOR(right_a.bitwiseAND(left_b)))


def vault_section(path: Column) -> Column:
    """First component of a relative path; a file at the root is its own."""
    return F.split(path, "/")[0]


def vault_section_or_null(path: Column) -> Column:
    """First component of a relative path, null at the root."""
    return F.when(path.contains("/"), F.split(path, "/")[0])


def uri(scheme: str, path: Column) -> Column:
    """A path under a scheme, without leading slashes."""
    return F.concat(F.lit(f"{scheme}://"), F.regexp_replace(path, "^/+", ""))


#: Labels of document sources, the path patterns and the declared source that each has, in the order in which they count.
SOURCES = (
    ("Codex", ("codex://%",), "codex%"),
    ("OpenCode", ("config://opencode%", "log://opencode%"), "opencode%"),
    ("Vault", ("vault://%", "obsidian://%"), "vault%"),
)
BROWSER = ("Generated browser output", ("%playwright%", "%browser%"), None)
#: Event types that do not go to the memories.
TARGETS = {
    "task_complete": "experiences", "trade_opened": "trading_results", "trade_closed": "trading_results", "trade_signal": "trading_results",
    "backtest_complete": "trading_results",
}


def source_label(path: Column, metadata: Column | None = None, browser: bool = True) -> Column:
    """Where a document comes from, by its path or declared source; the first rule that holds counts."""
    meta = F.coalesce(F.get_json_object(metadata, "$.source"), F.lit("")) if metadata is not None else F.lit("")
    label = None
    for name, patterns, declared in (*SOURCES, *([BROWSER] if browser else [])):
        rule = reduce(lambda x, y: x | y, [path.like(p) for p in patterns] + ([meta.like(declared)] if declared else []))
        label = F.when(rule, name) if label is None else label.when(rule, name)
    return label.otherwise("Other")


def event_target(kind: Column) -> Column:
    """The table that an event type belongs to."""
    routes = F.create_map(*[F.lit(x) for pair in TARGETS.items() for x in pair])
    return F.coalesce(routes[kind], F.lit("memories"))


def retrieval_mode(healthy: Column, embedder: Column) -> Column:
    """How a store can be searched just now."""
    return F.when(~healthy, "degraded").when(embedder, "semantic").otherwise("keyword-only")


def next_action(paused: Column, reachable: Column, pending: Column, failed: Column) -> Column:
    """What a replication should do next."""
    return (
        F.when(paused, "paused").when(~reachable, "unreachable").when(pending > 0, "push").when(failed > 0, "retry").otherwise("idle")
    )


def agent_name(raw: Column) -> Column:
    """The name in a JSON value, a short plain value, or ``agent``."""
    named = F.nullif(F.trim(F.get_json_object(raw, "$.name")), F.lit(""))
    plain = F.when((F.length(F.trim(raw)) > 0) & (F.length(raw) < 40) & ~F.trim(raw).startswith("{"), F.trim(raw))
    return F.coalesce(named, plain, F.lit("agent"))


def model_name(raw: Column) -> Column:
    """The model in a JSON value or the value itself; overlong ones are unknown."""
    found = F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in ("modelID", "id", "name")], raw)
    return F.when((F.length(found) > 60) | (F.length(F.trim(found)) == 0), "unknown").otherwise(F.coalesce(found, F.lit("unknown")))


def without_surrogates(text: Column) -> Column:
    """Lone surrogates, as lossy decoders leave them, become question marks."""
    return F.regexp_replace(text, r"[\uD800-\uDFFF]", "?")


def without_surrogate_escapes(json: Column) -> Column:
    """Escapes of lone surrogates in JSON text become question marks, as JSON parsers refuse them; pairs stay."""
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    return F.regexp_replace(F.regexp_replace(json, f"{high}(?!{low})", "?"), f"(?<!{high}){low}", "?")


def truthy(value: Column) -> Column:
    """A setting's text as a boolean: ``true``, ``1`` and ``yes`` in any case."""
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("true", "1", "yes")


def composed(fields: dict[str, Column]) -> Column:
    """``name: value`` lines of the fields that are not blank."""
    line = lambda n, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{n}: "), c))
    return F.concat_ws("\n", *[line(n, c) for n, c in fields.items()])


def iso_from_millis(millis: Column) -> Column:
    """Epoch milliseconds as an ISO time in UTC."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss'Z'")
