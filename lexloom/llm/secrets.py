"""Secret scans with multipart credential linking, in built-in functions only.

Base kinds are exact patterns.  Weak parts (names of an account, addresses of a service, values whose
key only hints at a secret) mean little alone: sorted by place within their document, each is linked to
the nearest complementary part on either side, as an interval join within the document does, and is
reported only where one lies within ``SCOPE`` code points.

Defined cases: a null text is empty; empty texts have no spans; repeated rows each get their own result;
an empty table gives an empty one; work is near linear in a text of any length and any number of parts;
other columns pass untouched (``scan`` replaces only those named as its two results).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, chunks, matches, no_matches, running, spans_text, with_row

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: Weak parts, each with the role it plays in a credential.
ACCOUNT = r"""\b(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"""\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/_.-]*"""
HINTED = r"""\b(?i:pwd|passphrase|auth|private_?key|access_?key|credentials?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}"""
#: Gap, in code points, within which parts of one credential may stand.
SCOPE = 200
ORDER = {"assign": 0, "access": 1, "hex": 2, "account": 3, "endpoint": 4, "hinted": 5}
SECRET_KINDS, BASE_KINDS = ("assign", "hex", "hinted"), ("assign", "access", "hex")


def _any(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    kinds = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])
    keyed = F.transform(
        spans,
        lambda x: F.struct(x["s"].alias("s"), kinds[x["kind"]].alias("o"), x["e"].alias("e"), x["kind"].alias("kind")),
    )
    return F.array_sort(keyed)


def _linked(parts: Column, forward: bool) -> Column:
    """Flags, in order, of the parts with a complementary part before them (or after) within the scope."""
    far = -(1 << 40)
    ordered = parts if forward else F.reverse(parts)

    def reach(secret: bool) -> Column:
        """How far the parts of one role reach, up to each part."""
        mine = (lambda x: x["kind"].isin(*SECRET_KINDS)) if secret else (lambda x: ~x["kind"].isin(*SECRET_KINDS))
        edges = F.transform(ordered, lambda x: F.when(mine(x), x["e"] if forward else -x["s"]).otherwise(F.lit(far)))
        return running(edges, F.greatest, far)

    both = F.zip_with(reach(True), reach(False), lambda a, b: F.struct(a.alias("secret"), b.alias("other")))
    flags = F.zip_with(
        ordered,
        both,
        lambda x, r: (x["s"] if forward else -x["e"]) - F.when(x["kind"].isin(*SECRET_KINDS), r["other"]).otherwise(r["secret"]) <= SCOPE,
    )
    return flags if forward else F.reverse(flags)


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """__row, __text, __base and __spans: the spans are arrays of (s, o, e, kind), ordered.

    Parts are looked for only in texts that hold their fixed characters; the patterns decide.
    """
    out = with_row(docs, text_col).withColumn("__low", F.lower("__text"))
    text, low = F.col("__text"), F.col("__low")

    def found(when: Column, pattern: str, kind: str, group: int | None = None, least: int = 1) -> Column:
        hits = matches(text, pattern, kind, group)
        return F.when(when, F.filter(hits, lambda x: x["g"] >= least)).otherwise(no_matches())

    out = out.withColumn(
        "__base",
        F.concat(
            found(_any(low, "password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN, "assign", 1, 8),
            found(text.contains("AKIA"), ACCESS, "access", None, 16),
            found(text.rlike(HEX), HEX, "hex"),
        ),
    )
    secretish = F.exists("__base", lambda x: x["kind"] != "access")
    hinted = _any(low, "pwd", "passphrase", "auth", "privatekey", "private_key", "accesskey", "access_key", "credential")
    others = F.exists("__base", lambda x: x["kind"] == "access") | low.contains("://") | _any(
        low, "user", "login", "clientid", "client_id", "account"
    )
    out = out.withColumn(
        "__parts",
        F.when(
            (secretish | hinted) & others,
            F.concat(
                F.col("__base"),
                found(_any(low, "user", "login", "clientid", "client_id", "account"), ACCOUNT, "account"),
                found(low.contains("://"), ENDPOINT, "endpoint"),
                found(hinted, HINTED, "hinted"),
            ),
        ).otherwise(F.col("__base")),
    )
    out = out.withColumn("__base", _ordered(F.col("__base"))).withColumn("__parts", _ordered(F.col("__parts")))
    linked = F.zip_with(_linked(F.col("__parts"), True), _linked(F.col("__parts"), False), lambda a, b: a | b)
    weak = F.size("__parts") > F.size("__base")
    kept = F.transform(
        F.filter(
            F.zip_with(F.col("__parts"), linked, lambda x, ok: F.struct(x.alias("x"), ok.alias("ok"))),
            lambda p: p["ok"] | p["x"]["kind"].isin(*BASE_KINDS),
        ),
        lambda p: p["x"],
    )
    spans = F.when(weak, kept).otherwise(F.col("__base"))
    return out.select("__row", "__text", "__base", spans.alias("__spans"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secret_base`` and ``secret_spans``: arrays of (s, o, e, kind), ordered."""
    return added(_scanned(docs, text_col), docs, secret_base=F.col("__base"), secret_spans=F.col("__spans"))


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, digest of the base spans, all spans as text."""
    found = scan(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(spans_text(F.col("secret_base")), 256).alias("base_sha256"),
        spans_text(F.col("secret_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """``docs`` with every reported secret replaced by ``mark``; overlapping spans become one.

    Accounts and endpoints are context, not secrets: they stay.  ``length_col`` names a column that holds
    the text's length, if it is to follow; all other columns stay as they are.
    """
    found = _scanned(docs, text_col)
    text, hide = F.col("__text"), F.col("__hide")
    found = found.withColumn("__hide", F.filter("__spans", lambda x: x["kind"].isin("assign", "access", "hex", "hinted")))
    # Each span with the end of all before it: what lies between is kept, and a span that begins earlier joins the last.
    ends = F.concat(F.array(F.lit(0).cast("bigint")), running(F.transform(hide, lambda x: x["e"]), F.greatest))
    steps = F.zip_with(hide, F.slice(ends, 1, F.size(hide)), lambda x, e: F.struct(x["s"].alias("s"), x["e"].alias("e"), e.alias("at")))

    def between(part: Column, at: Column, end: Column) -> Column:
        return part.substr((at + 1).cast("int"), F.greatest(end - at, F.lit(0)).cast("int"))

    def clean(chunk: Column) -> Column:
        # A slice of spans reads from its own part of the text, so that places are counted from near by.
        first, last = F.get(chunk, 0)["at"], F.get(chunk, F.size(chunk) - 1)
        own = F.array(F.struct(between(text, first, F.greatest(last["s"], last["at"])).alias("t"), first.alias("b"), chunk.alias("c")))
        pieces = F.transform(
            own,
            lambda o: F.array_join(
                F.transform(o["c"], lambda x: F.when(x["s"] >= x["at"], F.concat(between(o["t"], x["at"] - o["b"], x["s"] - o["b"]), F.lit(mark))).otherwise(F.lit(""))),
                "",
            ),
        )
        return F.get(pieces, 0)

    tail = text.substr((F.array_max(F.transform(hide, lambda x: x["e"])) + 1).cast("int"), F.length(text))
    found = found.withColumn("__steps", steps).withColumn(
        "__clean", F.when(F.size(hide) > 0, F.concat(F.array_join(F.transform(chunks(F.col("__steps")), clean), ""), tail))
    )
    new = {text_col: F.coalesce(F.col("__clean"), F.col("__row")[text_col])}
    if length_col:
        own = F.col("__row")[length_col]
        new[length_col] = F.when(F.col("__clean").isNotNull(), F.length("__clean").cast(docs.schema[length_col].dataType)).otherwise(own)
    return added(found, docs, **new).select(*[F.col(f"`{c}`") for c in docs.columns])


def sql() -> str:
    """The result of ``digest`` in DuckDB SQL."""
    kinds = (
        (ASSIGN, "assign", 1, 8),
        (ACCESS, "access", 0, 16),
        (HEX, "hex", 0, 1),
        (ACCOUNT, "account", 0, 1),
        (ENDPOINT, "endpoint", 0, 1),
        (HINTED, "hinted", 0, 1),
    )
    parts = []
    for pattern, kind, group, _ in kinds:
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {ORDER[kind]} AS o, unnest(list_transform(range(1, len(h) + 1), lambda i: struct_pack("
            f"s := list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0), h := h[i], q := q[i]))) AS m "
            f"FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS h, regexp_extract_all(text, {p}, {group}) AS q, regexp_split_to_array(text, {p}) AS g FROM documents) WHERE len(h) > 0"
        )
    found = " UNION ALL ".join(
        f"SELECT doc_id, kind, o, CAST(m.s AS BIGINT) AS s, CAST(m.s + length(m.h) AS BIGINT) AS e FROM ({part}) WHERE length(m.q) >= {least}"
        for part, (_, _, _, least) in zip(parts, kinds, strict=True)
    )
    base, secret = "('assign', 'access', 'hex')", "('assign', 'hex', 'hinted')"
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e)"
    return f"""
WITH part AS ({found}),
linked AS (SELECT * FROM part x WHERE kind IN {base} OR EXISTS (SELECT 1 FROM part y WHERE y.doc_id = x.doc_id AND (y.kind IN {secret}) <> (x.kind IN {secret})
 AND CASE WHEN (y.s, y.o, y.e) < (x.s, x.o, x.e) THEN x.s - y.e ELSE y.s - x.e END <= {SCOPE})),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 {text} FILTER (kind IN {base}) AS base, {text} AS spans FROM linked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)"""
