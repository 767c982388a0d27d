"""Secret scan with corpus-wide ownership frequency.

Candidates of every whole text are hashed and aggregated by distinct repositories and owners. A value that several owners or many
repositories carry is a widely copied example (documentation, test vectors); one that a single owner carries in few repositories, with the
entropy of a generated value, is an owner-specific, live-looking credential. The base kinds are reported whatever their frequency; the
loose kinds (private-key blocks, JSON web tokens, prefixed provider keys, credentials in URLs, high-entropy values after
further key words) become spans only if they are owner-specific and live-looking.

Cases. Null texts are empty; a null repository or owner is one of its own. Ties: spans by begin, then kind as listed. Repeated rows
give repeated rows and count once for a value's owners; other columns are not read; empty tables give no rows. Searches take time linear in
the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haystrata.llm.common import grouped, join_counted, staged
from haystrata.llm.spans import Span, digest

BASE = ("assign", "access", "hex")
LOOSE = ("private_key", "jwt", "provider", "url_login", "keyed")
#: Owners from which on a value counts as widely copied.
WIDE_OWNERS = 3
#: Repositories from which on it does.
WIDE_REPOS = 8
#: Bits a character that a live-looking value has at least.
ENTROPY = 3.0
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What a text must hold for a match (of keyed: in lower case, as its pattern ignores case), and the pattern.
_LOOSE = {
    "private_key": (("-----BEGIN ",), re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----([A-Za-z0-9+/=\s]{32,})-----END")),
    "jwt": (("eyJ",), re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    "provider": (("ghp", "gho", "ghs", "glpat", "sk_live", "rk_live", "xoxb", "xoxp", "npm"), re.compile(r"\b((?:ghp|gho|ghs|glpat|sk_live|rk_live|xoxb|xoxp|npm)[_-][A-Za-z0-9_-]{16,})")),
    "url_login": (("://",), re.compile(r"://[^\s/:@]{1,64}:([^\s/@:]{8,128})@")),
    "keyed": (("key",), re.compile(r"""(?:access|auth|client|private|signing|encryption)[_-]?key["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_=-]{16,})""", re.I | re.A)),
}


def base_spans(text: str) -> list[tuple[Span, str]]:
    """The base matches with their values, by begin, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(("assign", m.start(), m.end()), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(("access", m.start(), m.end()), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(("hex", m.start(), m.end()), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0][1], BASE.index(x[0][0])))


def loose_spans(text: str) -> list[tuple[Span, str]]:
    """Candidates of the loose kinds: the value's own span."""
    low = text.lower()
    return [((kind, m.start(1), m.end(1)), m[1]) for kind, (signs, pattern) in _LOOSE.items() if any(s in (low if kind == "keyed" else text) for s in signs) for m in pattern.finditer(text)]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def col(c):
    return F.col(c) if isinstance(c, str) else c


def candidates(docs: DataFrame, repo, owner) -> DataFrame:
    """repo, owner: columns or their names. One row for each row of docs: rid, doc_id, repo, owner, base counts and digest, and found: its candidates in order of begin and kind."""
    kinds = (*BASE, *LOOSE)
    one_type = pa.struct([("at", pa.int64()), ("to", pa.int64()), ("kind", pa.string()), ("h", pa.int64()), ("live", pa.bool_())])
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("repo", pa.string()), ("owner", pa.string()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("found", pa.list_(one_type))])

    def one(batch):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "found")}
        for text in batch.column(4).to_pylist():
            base = base_spans(text or "")
            count = Counter(s[0] for s, _ in base)
            for k in BASE:
                out[f"n_{k}"].append(count[k])
            out["base_sha256"].append(digest([s for s, _ in base]))
            every = sorted([*base, *loose_spans(text or "")], key=lambda x: (x[0][1], kinds.index(x[0][0])))
            out["found"].append([{"at": a, "to": b, "kind": k, "h": int.from_bytes(blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), "live": entropy(v) >= ENTROPY} for (k, a, b), v in every])
        return out | {k: batch.column(i) for i, k in enumerate(("rid", "doc_id", "repo", "owner"))}

    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), col(repo).cast("string").alias("repo"), col(owner).cast("string").alias("owner"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: grouped(it, "text", schema, one), "rid long, doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<at:long,to:long,kind:string,h:long,live:boolean>>")


def ownership(found: DataFrame) -> DataFrame:
    """(h, n, n_repos, n_owners) of candidate rows (h, repo, owner). A null repository or owner is one of its own."""
    name = [F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(c) for c in ("repo", "owner")]
    each = found.select("h", *name).groupBy("h", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))  # a hot value is at most one row a task and owner from here
    return each.groupBy("h").agg(F.sum("n").alias("n"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def scan_secrets(docs: DataFrame, repo="source", owner="source", wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied; one row for each row of docs.

    spans: all base spans, and loose ones that are owner-specific and live-looking, as kind:begin:end by begin and kind.
    n_live, n_copied: candidates of any kind that are owner-specific and live-looking, or that wide_owners owners or wide_repos repositories carry.
    Null texts are empty. Null and repeated ids go through as they are.
    """
    rows = staged(candidates(docs, repo, owner))
    found = rows.where(F.size("found") > 0).select("rid", "repo", "owner", F.explode("found").alias("c")).select("rid", "repo", "owner", "c.*")
    wide = (F.col("n_owners") >= wide_owners) | (F.col("n_repos") >= wide_repos)
    freq = staged(ownership(found).select("h", "n", wide.alias("wide"), (~wide & (F.col("n_owners") == 1)).alias("own")))
    judged = join_counted(found.select("rid", "at", "to", "kind", "h", "live"), freq, "h")
    order = F.element_at(F.create_map(*[x for i, k in enumerate((*BASE, *LOOSE)) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    kept = F.col("kind").isin(*BASE) | F.col("own") & F.col("live")
    text = F.concat_ws(":", "kind", "at", "to")
    by = judged.groupBy("rid").agg(F.array_sort(F.collect_list(F.when(kept, F.struct("at", order.alias("k"), text.alias("s"))))).alias("all"), F.count_if(F.col("own") & F.col("live")).alias("n_live"), F.count_if("wide").alias("n_copied"))
    by = by.select("rid", F.concat_ws(",", F.transform("all", lambda x: x["s"])).alias("spans"), "n_live", "n_copied")
    out = rows.select("rid", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256").join(by, "rid", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))
