"""Secret scanning with an incremental ledger of content-addressed texts.

Every version of a text is addressed by its SHA-256. The ledger holds one row
per blob and rule version that was scanned, with the spans found, so a blob is
scanned once however many paths, versions or runs hold it. Findings are joined
back to all paths by address.

Cases: a null text is the empty text. Rows with a null id, repeated rows and
rows with equal ids come back one for one. An empty table gives no rows. Texts
and tokens of any length are scanned whole, in time in proportion to the text;
a scheme in a url starts at its first letter. Other columns of any name pass
through.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, functions as F

from incidentkit.llm.common import per_text
from incidentkit.session import checkpoint, scratch

# The three base kinds with the length that a match must have.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
# Further kinds of this library.
MORE = (
    ("private_key", re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    ("jwt", re.compile(rb"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
    ("hub_token", re.compile(rb"gh[pousr]_[A-Za-z0-9]{36,}")),
)
#: User and password of a url, found from the middle, so that no run of letters is read more than once.
LOGIN = re.compile(rb"://[^\s/:@]++:[^\s/:@]{3,}+@")
SCHEME = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789+.-")
KINDS = ("assign", "access", "hex", *(kind for kind, _ in MORE), "url_login")
BASE = KINDS[:3]
RULES = hashlib.sha256("\n".join(p.pattern.decode() for p in (ASSIGN, ACCESS, HEX, *(p for _, p in MORE), LOGIN)).encode()).hexdigest()[:16]
#: Rows of ids that are sent to every executor at most; beyond that texts are shuffled by id.
BROADCAST_ROWS = 200_000


def find_spans(text: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind as listed.

    All patterns match ASCII only, so they run over the UTF-8 bytes; offsets are
    turned into code points for the few matches. A run of hex digits or capitals
    is maximal, so asking for its least length finds the same matches as dropping
    the short ones; the value of an assignment is tested after the match.
    """
    text = text or b""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for kind, pattern in MORE:
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    found += [("url_login", start, end) for start, end in _logins(text)]
    if found and not text.isascii():
        points, at, count = {}, 0, 0
        for cut in sorted({x for _, s, e in found for x in (s, e)}):
            count += len(text[at:cut].decode("utf-8", "replace"))
            points[cut], at = count, cut
        found = [(kind, points[s], points[e]) for kind, s, e in found]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def _logins(text: bytes):
    """Urls with a password, from the first letter of their scheme, which has two characters at least."""
    for m in LOGIN.finditer(text):
        start = m.start()
        while start and text[start - 1] in SCHEME:
            start -= 1
        while start < m.start() and not 97 <= text[start] <= 122:
            start += 1
        if m.start() - start >= 2:
            yield start, m.end()


def _written(text: bytes | None) -> tuple[str]:
    return (",".join(f"{kind}:{s}:{e}" for kind, s, e in find_spans(text)),)


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(docs: DataFrame, ledger: str | None = None, key: str = "doc_id") -> DataFrame:
    """Key, blob and spans (kind:start:end, comma-joined) of every row.

    ``ledger`` is the folder of the ledger table; what it does not hold under
    the present rules is scanned and appended. Without one, a new ledger is
    written below the shared folder. Texts are fetched by the id of one row per
    new blob: next to a broadcast id list where that was counted small, by a
    shuffle beyond.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch(spark, "ledger")
    text = F.col("text").cast("string")
    paths = checkpoint(docs.select(F.col(key).cast("long").alias("path"), address(text).alias("blob")))
    known = _known(spark, ledger)
    new = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if known is not None:
        new = new.join(known.where(F.col("rules") == RULES).select("blob"), "blob", "left_anti")
    new = checkpoint(new)
    count = new.count()
    if count:
        named = new.where(F.col("path").isNotNull()).select("path", F.col("blob").alias("wanted"))
        rows = docs.select(F.col(key).cast("long").alias("path"), text.alias("text"))
        picked = rows.join(F.broadcast(named) if count <= BROADCAST_ROWS and count * 20 <= paths.count() else named.hint("shuffle_merge"), "path")
        # Rows that share an id may hold other texts: only the wanted blob counts.
        picked = picked.where(address(F.col("text")) == F.col("wanted")).select("wanted", "text")
        # Blobs that only rows without an id hold.
        lone = new.where(F.col("path").isNull()).select(F.col("blob").alias("wanted"))
        bare = rows.where("path is null").select(address(F.col("text")).alias("wanted"), "text").join(lone, "wanted", "left_semi")
        done = per_text(picked.unionByName(bare), "blob binary, spans string", lambda: _written)
        done.withColumn("rules", F.lit(RULES)).write.mode("append").parquet(ledger)
    held = spark.read.schema(LEDGER).parquet(ledger) if count or known is not None else spark.createDataFrame([], LEDGER)
    # A blob whose rows repeat one id may be written twice with the same spans; both sides stay plain, so a hot blob can be split.
    found = checkpoint(held.where((F.col("rules") == RULES) & (F.col("spans") != "")).select("blob", "spans").distinct())
    return paths.join(found, "blob", "left").select(F.col("path").alias(key), "blob", F.coalesce("spans", F.lit("")).alias("spans"))


LEDGER = "blob binary, spans string, rules string"


def _known(spark, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(LEDGER).parquet(ledger) if fs.exists(path) else None


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and the hash of the base spans."""
    spans = F.filter(F.split("spans", ","), lambda s: s != "")
    of = lambda kind: lambda s: s.startswith(f"{kind}:")
    base = F.filter(spans, lambda s: F.substring_index(s, ":", 1).isin(*BASE))
    counts = [F.size(F.filter(spans, of(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return scanned.select(key, *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[secret]") -> DataFrame:
    """Documents with every found span replaced by a mark; n_chars, where present, follows.

    Rows without findings are passed on as they are: only the others meet their spans.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col("text").cast("string")
    # The row travels as one column, so that no column of it can clash.
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("id"), address(text).alias("held"), text.alias("text"))
    found = scan(docs, ledger).where("spans <> ''").select(F.col("doc_id").alias("of"), "blob", "spans").distinct()
    cuts = F.transform(F.split("spans", ","), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("s"), F.split(s, ":")[2].cast("int").alias("e")))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    text = F.col("text")
    step = lambda acc, c: F.when(c["s"] < acc["at"], F.struct(acc["done"].alias("done"), F.greatest(acc["at"], c["e"]).alias("at"))).otherwise(
        F.struct(F.concat(acc["done"], F.substr(text, acc["at"] + 1, c["s"] - acc["at"]), F.lit(mark)).alias("done"), c["e"].alias("at")))
    whole = F.aggregate(cuts, start, step, lambda acc: F.concat(acc["done"], F.substr(text, acc["at"] + 1)))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("held") == F.col("blob")), "left")
    out = out.withColumn("text", F.when(F.col("spans").isNull(), text).otherwise(whole))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
