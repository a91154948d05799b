"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

``find_spans``      documents -> a row a document with its candidate spans
                    (kind, start, end in code points, hash of the secret part)
``ownership``       candidates -> a row a secret: in how many documents,
                    distinct repositories and distinct owners it stands, and
                    whether it is a widely copied example or looks live
``scan``            both, joined: a row a document

Candidates are found by one regular expression a kind. Only documents that hold
a candidate take the second step, which cuts the text at the matches: lengths
of the parts between and of the matches sum up to positions. The corpus-wide
counts are taken over (hash, repository, owner) after partial aggregation, so a
secret that stands in a third of all documents sends one row a task. Texts are
not shuffled.

A secret is an *example* if more than ``owner_limit`` owners or more than
``repo_limit`` repositories have it, or it holds no entropy (few distinct
characters) or a placeholder word; else it is *live-looking*.

Defined results: a null text is empty; a null repository or owner counts as one
value; repeated rows count once for ownership and each has its spans; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Numbered, stored

#: Kind -> (pattern, group of the secret part, its least length).
#: The first three are the base kinds, in their order; a match whose secret
#: part is shorter is dropped.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "bearer": (r"[Bb]earer\x20+([A-Za-z0-9._~+/-]+=*)", 1, 16),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "prefixed": (r"\b(?:gh[opsu]_|xox[abp]-|sk_live_)[A-Za-z0-9_-]+", 0, 20),
}
BASE = ("assign", "access", "hex")
#: Strings of which a text must hold one before a kind's pattern is tried.
HINTS: dict[str, tuple[str, ...]] = {
    "assign": ("=", ":"),
    "access": ("AKIA",),
    "hex": (),
    "bearer": ("earer ",),
    "jwt": ("eyJ",),
    "pem": ("PRIVATE KEY-----",),
    "prefixed": ("gh", "xox", "sk_live_"),
}
PLACEHOLDER = "(?i)example|changeme|placeholder|your[_-]|xxxx|dummy|sample"
SPANS = "array<struct<start:int,kind:int,end:int,hash:bigint,plain:boolean>>"


def _spans(kind: str, order: int) -> Column:
    """Spans of one kind in ``text``: parts between matches and matches take
    turns, so positions are running sums of their lengths."""
    pattern, group, least = KINDS[kind]
    gaps = F.expr("transform(split(text, {0}, -1), x -> length(x))".format(_literal(pattern)))
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("found"), secret.alias("secret"))
    begun = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPANS})").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(F.length(x["found"]), F.lit(0))).alias("at"),
            F.when(
                F.length(x["secret"]) >= least,
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            F.lit(order).alias("kind"),
                            (acc["at"] + x["gap"] + F.length(x["found"])).alias("end"),
                            F.xxhash64(x["secret"]).alias("hash"),
                            ((F.size(F.array_distinct(F.split(x["secret"], ""))) < 6) | x["found"].rlike(PLACEHOLDER)).alias("plain"),
                        )
                    ),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )
    return begun["out"]


def _may_hold(kind: str) -> Column:
    """Plain searches first: most texts end there."""
    test = F.col("text").rlike(KINDS[kind][0])
    if HINTS[kind]:
        test = functools.reduce(operator.or_, (F.contains("text", F.lit(h)) for h in HINTS[kind])) & test
    return test


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_spans(docs: DataFrame, repo: str = "source", owner: str | None = None) -> DataFrame:
    """doc_id, repo, owner, n_chars, spans (by start, then kind). ``owner``: a
    column; None: the part of the repository's name before its first slash
    (``owner/repository``; all of it without one)."""
    own = Numbered(docs)
    of = lambda name: F.coalesce(own.column(name, "string"), F.lit(""))
    holder = of(owner) if owner else F.substring_index(of(repo), "/", 1)
    rows = own.rows.select(own.column("doc_id", "long").alias("doc_id"), of("text").alias("text"), of(repo).alias("repo"), holder.alias("owner"))
    empty = F.expr(f"cast(array() as {SPANS})")
    parts = [F.when(_may_hold(k), _spans(k, i)).otherwise(empty) for i, k in enumerate(KINDS)]
    return rows.select("doc_id", "repo", "owner", F.length("text").cast("long").alias("n_chars"), F.array_sort(F.concat(*parts)).alias("spans"))


def ownership(spans: DataFrame, owner_limit: int = 2, repo_limit: int = 3) -> DataFrame:
    """A row a secret: hash, n_uses, n_repos, n_owners, example."""
    each = spans.where(F.size("spans") > 0).select("repo", "owner", F.explode("spans").alias("s")).select("repo", "owner", "s.hash", "s.plain")
    once = each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"), F.max("plain").alias("plain"))
    total = once.groupBy("hash").agg(F.sum("n").alias("n_uses"), F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"), F.max("plain").alias("plain"))
    return total.withColumn("example", F.col("plain") | (F.col("n_owners") > owner_limit) | (F.col("n_repos") > repo_limit))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, repo: str = "source", owner: str | None = None) -> DataFrame:
    """A row a document: counts and digest of base spans, all spans, and how
    many of its secrets are examples and look live."""
    spans = stored(find_spans(docs, repo, owner).withColumn("row", F.monotonically_increasing_id()), "spans")
    owned = stored(ownership(spans).select("hash", "example"), "owned")
    # many rows may have one hash: both sides are dealt by the join alone, so
    # that adaptive execution can split such a hash's rows
    judged = spans.where(F.size("spans") > 0).select("row", F.explode("spans.hash").alias("hash")).join(owned, "hash")
    found = judged.groupBy("row").agg(F.count_if(~F.col("example")).alias("n_live"), F.count_if("example").alias("n_example"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")
    none = F.lit(0).cast("long")
    return spans.join(found, "row", "left").select(
        "doc_id", count(0), count(1), count(2), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_example", none).alias("n_example"),
    )
