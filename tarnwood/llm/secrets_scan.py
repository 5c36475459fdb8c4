"""Secrets in texts: base patterns, and weak credential parts that complete each other.

Everything is DataFrame expressions over one row: no Python, no shuffle. Matches
of a pattern get their positions from the lengths of what lies between them, so
a text is scanned by Java's regex engine only.

Multipart linking is an interval join inside a document. Parts take one of three
roles: access identifier, secret, endpoint. Their spans are ordered by start,
and running maxima of ends and of next starts, per role, tell for every part
whether a part of another role lies within its scope of ``scope`` code points;
the join is linear in the parts, with no pair ever formed. A weak part is
reported only if its complement is there: a bare key next to an identifier, an
identifier next to a secret, an endpoint next to both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns. The assignment's value needs six characters or more.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Patterns of weak parts: an identifier with its label, a bare 40-character key, an address.
WEAK_ID = r"""(?i)(?:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
WEAK_KEY = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{4,}"""
#: Base kinds in the order in which they break ties, then the weak ones.
KINDS = ("assign", "access", "hex", "weak_id", "weak_key", "endpoint")
_ROLES = {"assign": "s", "access": "i", "hex": "s", "weak_id": "i", "weak_key": "s", "endpoint": "e"}
_BLOCK = 64
_FAR = 1 << 40


def running(rows: DataFrame, source: str, target: str, join) -> DataFrame:
    """``rows`` with the running results of an associative operation over an array column.

    In two levels: inside blocks of ``_BLOCK``, then over the blocks.
    """
    n = F.size(source)
    starts = F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))
    parts = F.transform(starts, lambda b: F.slice(source, b * _BLOCK + 1, F.lit(_BLOCK)))
    fold = lambda a, b: join(a, b)
    within = F.transform(parts, lambda p: F.transform(p, lambda x, i: F.aggregate(F.slice(p, F.lit(1), i), x, fold)))
    rows = rows.withColumn("_within", F.when(n > 0, within))
    ends = F.transform("_within", lambda p: F.element_at(p, -1))
    before = F.aggregate(
        ends, F.array().cast("array<bigint>"),
        lambda done, e: F.concat(done, F.array(F.when(F.size(done) > 0, join(F.element_at(done, -1), e)).otherwise(e))),
    )
    rows = rows.withColumn("_before", F.when(n > 0, before))
    carried = F.transform(
        "_within", lambda p, b: F.when(b > 0, F.transform(p, lambda x: join(F.get(F.col("_before"), b - 1), x))).otherwise(p)
    )
    flat = F.when(n > 0, F.flatten(carried)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn(target, flat).drop("_within", "_before")


_NO_SPANS = "array<struct<start:bigint,end:bigint,kind:int>>"


def _with_matches(rows: DataFrame, text: Column, pattern: str, kind: str, keep=None) -> DataFrame:
    """``rows`` with the column ``_<kind>``: spans of the leftmost non-overlapping matches.

    What is looked up by index inside a lambda is a column of its own first: an
    expression there would be evaluated anew for each element.
    """
    rows = rows.withColumn("_hits", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size("_hits") > 0
    rows = rows.withColumn("_gaps", F.when(some, F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))))
    before = lambda i: F.when(i > 0, F.length(F.get(F.col("_hits"), i - 1))).otherwise(F.lit(0))
    rows = rows.withColumn("_steps", F.when(some, F.transform("_hits", lambda _, i: F.get(F.col("_gaps"), i) + before(i))))
    rows = running(rows, "_steps", "_starts", lambda a, b: a + b)
    spans = F.zip_with(
        "_hits", "_starts",
        lambda h, s: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), h.alias("hit")),
    )
    if keep is not None:
        spans = F.filter(spans, lambda x: keep(x["hit"]))
    spans = F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"])).cast(_NO_SPANS)
    rows = rows.withColumn(f"_{kind}", F.when(some, spans).otherwise(F.array().cast(_NO_SPANS)))
    return rows.drop("_hits", "_gaps", "_steps", "_starts")


def _mixed(hit: Column) -> Column:
    """Exactly 40 characters with lower case, upper case and digits: no word and no other base kind."""
    return (F.length(hit) == 40) & hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9]")


def _with_reach(rows: DataFrame, role: str) -> DataFrame:
    """For each index of ``_parts``: the furthest end so far and the next start of a part of ``role``."""
    mine = [k for k, name in enumerate(KINDS) if _ROLES[name] == role]
    rows = rows.withColumn("_ends", F.transform("_parts", lambda p: F.when(p["kind"].isin(*mine), p["end"]).otherwise(F.lit(-_FAR))))
    starts = F.transform("_parts", lambda p: F.when(p["kind"].isin(*mine), p["start"]).otherwise(F.lit(_FAR)))
    rows = running(rows.withColumn("_begins", F.reverse(starts)), "_ends", f"_{role}_end", lambda a, b: F.greatest(a, b))
    rows = running(rows, "_begins", "_nexts", lambda a, b: F.least(a, b))
    return rows.withColumn(f"_{role}_start", F.reverse("_nexts")).drop("_ends", "_begins", "_nexts")


def find_secrets(docs: DataFrame, *, text_col: str = "text", scope: int = 200) -> DataFrame:
    """The rows of ``docs`` with ``base_spans``, ``weak_spans`` and ``spans`` added.

    Spans are arrays of (start, end, kind), in code points, the end exclusive,
    ordered by start, then kind as in ``KINDS``. Null and empty texts
    have none. All columns of ``docs`` stay, whatever their names, but for former
    columns of the three names, which are replaced. Repeated rows are scanned
    each; an empty table stays empty.
    """
    own, rows = docs.columns, _wrapped(docs)
    rows = rows.withColumn("_text", F.coalesce(F.col("_document").getField(text_col), F.lit("")))
    text = F.col("_text")
    found = _with_matches(rows, text, ASSIGN, "assign", lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6)
    found = _with_matches(found, text, ACCESS, "access")
    found = _with_matches(found, text, HEX, "hex")
    found = _with_matches(found, text, WEAK_ID, "weak_id")
    found = _with_matches(found, text, WEAK_KEY, "weak_key", _mixed)
    found = _with_matches(found, text, ENDPOINT, "endpoint")
    found = found.withColumn("base_spans", _by_start(F.concat("_assign", "_access", "_hex")))
    found = found.withColumn("_some", (F.size("_weak_id") > 0) | (F.size("_weak_key") > 0) | (F.size("_endpoint") > 0))
    parts = F.array_sort(F.concat("base_spans", "_weak_id", "_weak_key", "_endpoint"))
    found = found.withColumn("_parts", F.when(F.col("_some"), parts).otherwise(F.array().cast(_NO_SPANS)))
    for role in "is":
        found = _with_reach(found, role)

    def beside(role: str, p: Column, i: Column) -> Column:
        return (F.get(F.col(f"_{role}_end"), i) >= p["start"] - scope) | (F.get(F.col(f"_{role}_start"), i) <= p["end"] + scope)

    wants = {"weak_id": "s", "weak_key": "i", "endpoint": "is"}
    linked = F.filter(
        "_parts",
        lambda p, i: reduce(
            lambda a, b: a | b,
            [(p["kind"] == KINDS.index(k)) & reduce(lambda a, b: a & b, [beside(r, p, i) for r in roles]) for k, roles in wants.items()],
        ),
    )
    found = found.withColumn("weak_spans", linked)
    found = found.withColumn("spans", _by_start(F.concat("base_spans", "weak_spans")))
    kept = [F.col("_document").getField(c).alias(c) for c in own if c not in ("base_spans", "weak_spans", "spans")]
    return found.select(*kept, "base_spans", "weak_spans", "spans")


def _wrapped(rows: DataFrame) -> DataFrame:
    """Each row as one struct, so that no name of its columns meets one of ours."""
    return rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("_document"))


def _by_start(spans: Column) -> Column:
    """By start, then kind."""
    turned = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.transform(turned, lambda s: F.struct(s["start"], s["end"], s["kind"]))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, *, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The text with every span, overlapping ones as one, replaced by ``mask``; a text without spans stays as it is."""
    own, rows = found.columns, _wrapped(found)
    rows = rows.withColumn("_spans", F.col("_document.spans")).withColumn("_text", F.col("_document").getField(text_col))
    spans, text = F.col("_spans"), F.col("_text")
    rows = running(rows.withColumn("_stops", F.transform(spans, lambda s: s["end"])), "_stops", "_reach", lambda a, b: F.greatest(a, b))
    done = lambda i: F.when(i > 0, F.get(F.col("_reach"), i - 1)).otherwise(F.lit(0).cast("long"))
    cut = lambda a, n: F.substring(text, (a + 1).cast("int"), n.cast("int"))
    pieces = F.transform(
        spans,
        lambda s, i: F.when((s["start"] >= done(i)) & ((i == 0) | (s["start"] > done(i))), F.concat(cut(done(i), s["start"] - done(i)), F.lit(mask)))
        .when(s["start"] == done(i), F.lit(mask)).otherwise(F.lit("")),
    )
    last = F.element_at(F.col("_reach"), -1)
    clean = F.concat(F.array_join(pieces, ""), cut(last, F.length(text).cast("long") - last))
    clean = F.when(F.size(spans) > 0, clean).otherwise(text)
    return rows.select(*[clean.alias(c) if c == text_col else F.col("_document").getField(c).alias(c) for c in own])
