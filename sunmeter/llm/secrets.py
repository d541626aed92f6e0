"""Secret scans: candidates in texts, told apart by who owns the copies."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmeter.llm.common import map_rows, settled

# The kinds every scan reports, in this order, with their pattern, the
# group that holds the value, and its least length.  Letters of names in either
# case are ASCII letters.  Runs that are too short are no matches; where a kind is
# one run of characters, the length is part of the pattern.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
BASE_KINDS = ("assign", "access", "hex")

# Further kinds, found by their form.
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
# A token begins a run of its characters, and runs are never taken back: one pass.
WEB_TOKEN = re.compile(
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+")
HOST_TOKEN = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
FORM_KINDS = (("private_key", PRIVATE_KEY), ("web_token", WEB_TOKEN), ("host_token", HOST_TOKEN))

# A value judged live is reported once more, as this kind.
LIVE = "live"
KINDS = (*BASE_KINDS, *(name for name, _ in FORM_KINDS), LIVE)

# A value with at least so many owners is an example that people copy.
EXAMPLE_OWNERS = 3
# So is one that each of its owners has in more than so many repositories on average:
# a sample in a template, where a credential of one's own stands in a few places.
EXAMPLE_REPOSITORIES = 100

_NAMES = ("password", "passwd", "secret", "token", "api")


def spans_of(text: str | None) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) by start, then kind; null is an empty text."""
    text = text or ""
    out = []
    small = text.lower()  # only to skip texts without any of the names
    if any(name in small for name in _NAMES):
        out += [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text)
                if len(m[2]) >= ASSIGN_LEAST]
    for kind, pattern in (("access", ACCESS), ("hex", HEX), *FORM_KINDS):
        out += [(kind, *m.span(), *m.span()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda span: (span[1], KINDS.index(span[0])))


def looks_random(value: str) -> bool:
    """Whether a value could be a generated credential: long, mixed, without much repetition."""
    return (len(value) >= 16 and len(set(value)) >= 8
            and any(c.isdigit() for c in value) and any(c.isalpha() for c in value))


def candidates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", owner: str = "source",
) -> DataFrame:
    """One row per document: its owner and ``spans``, with a digest of each value.

    The values themselves are not kept.  Places count code points, ends are exclusive.
    """
    kinds = [docs.schema[name].dataType.simpleString() for name in (id_column, owner)]
    ddl = (f"`{id_column}` {kinds[0]}, `{owner}` {kinds[1]}, spans array<struct<kind:string,"
           "start:long,end:long,value_start:long,value_end:long,digest:string,random:boolean>>")

    def per_task():
        def of(key, who, value):
            value = value or ""
            spans = []
            for span in spans_of(value):
                secret = value[span[3]:span[4]]
                digest = hashlib.sha256(secret.encode("utf-8", "surrogatepass")).hexdigest()
                spans.append((*span, digest, looks_random(secret)))
            return key, who, spans

        return of

    return map_rows(docs.select(id_column, owner, text), per_task, ddl)


def ownership(found: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """Corpus-wide frequency of each digest: distinct repositories and owners.

    ``verdict`` is ``example`` for what ``EXAMPLE_OWNERS`` or more owners have, or each
    in over ``EXAMPLE_REPOSITORIES`` repositories on average, ``live`` for values of fewer owners that look random, else ``weak``.  A null
    owner or repository counts as one of its own.  Each copy is reduced to one
    row per repository before owners are counted, and every step is aggregated
    before the shuffle, so a value with millions of copies is many small sums.
    """
    spans = found.select(
        F.col(owner).alias("who"), F.col(repository).alias("where"), F.inline("spans"))
    held = spans.groupBy("digest", "who", "where").agg(F.max("random").alias("random"))
    owners = held.groupBy("digest", "who").agg(
        F.count("*").alias("n_repositories"), F.max("random").alias("random"))
    return owners.groupBy("digest").agg(
        F.sum("n_repositories").alias("n_repositories"),
        F.count("*").alias("n_owners"),
        F.max("random").alias("random"),
    ).withColumn("verdict", F.when(
        (F.col("n_owners") >= EXAMPLE_OWNERS)
        | (F.col("n_repositories") > EXAMPLE_REPOSITORIES * F.col("n_owners")), "example")
                 .when(F.col("random"), "live").otherwise("weak"))


def scan(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", owner: str = "source",
) -> DataFrame:
    """One row per document with ``spans`` and ``live_spans``; each document is a repository.

    ``live_spans`` are the values whose verdict over the whole corpus is
    ``live``.  Texts are read once: the candidates are stored, then counted and
    joined back by digest and document, without any text.  Null and empty texts
    have no spans; repeated rows give repeated rows, and are one repository; rows
    with a null id are one repository too.
    """
    found = settled(candidates(docs, id_column, text, owner), "secret-candidates")
    live = ownership(found, id_column, owner).filter(F.col("verdict") == "live")
    # Reversed digests are a new key to Spark: both sides are dealt out for the join,
    # and a digest with many copies is split.
    pairs = (found.select(F.col(id_column).alias("repository"), F.inline("spans"))
             .select("repository", F.reverse("digest").alias("key")))
    held = (pairs.join(live.select(F.reverse("digest").alias("key")), "key", "left_semi")
            .groupBy("repository").agg(F.collect_set("key").alias("keys")))
    joined = found.join(held, found[id_column].eqNullSafe(held["repository"]), "left")
    is_live = F.filter("spans", lambda s: F.array_contains("keys", F.reverse(s["digest"])))
    live_spans = F.array_distinct(F.transform(is_live, lambda s: F.struct(
        F.lit(LIVE).alias("kind"), s["value_start"].alias("start"), s["value_end"].alias("end"))))
    return joined.select(
        id_column, owner, "spans",
        F.coalesce(live_spans, F.array().cast("array<struct<kind:string,start:long,end:long>>"))
        .alias("live_spans"))


def joined_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas in the order they have."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    place = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS))) for x in pair])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"),
        s["kind"].alias("kind")))
    return F.array_sort(keyed)
