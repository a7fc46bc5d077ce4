"""Near duplicates by Jaccard similarity of word shingles, found through a partitioned universe.

Two sets with similarity 0.75 differ in at most a seventh of their summed sizes. For each band of
sizes the universe of shingles is hashed into segments, twice as many as such a difference can touch.
Among one more non-empty segments than can differ, one is the same in both sets, so a set is indexed
by the hashes of its first so many segments. Segments whose content is common in the corpus are passed
over for later ones (``_signatures`` has the allocation and why no pair is lost): where too few
uncommon ones are left, a set also gets the hashes of its segments less one shingle, and a segment so
extended counts for two. Only a set for which that is not enough is indexed under common segments too.

Candidates that sizes and short profiles of the sets do not rule out are checked over the whole sets
(``linking``). Which segments count as common changes the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm import linking
from panelweave.llm.linking import class_key
from panelweave.llm.shared import free_name, small_batches
from panelweave.llm.shingles import mix, shingle_set
from panelweave.session import materialize

PERCENT = 75
#: Signatures that one task sorts.
PART_SIGNATURES = 400_000
#: Of so many documents one is looked at for common segments, at least COMMON_LEAST in all.
COMMON_ONE_IN, COMMON_LEAST = 20, 4_000
#: Times a segment's content must occur in the sample to be common, and how many are remembered.
COMMON_TIMES, COMMON_MAX = 5, 200_000
#: Classes that a task indexes once only, and parts among which the holders of a common signature are dealt.
SEEN, SPREAD = 500_000, 16
#: Bytes of text that come to one shingle, for the number of parts.
SHINGLE_BYTES = 6
#: Numbers in a set's profile, at least, and shingles that come to one number in larger sets.
PROFILE, PROFILE_SHINGLES = 128, 8
CHUNK = 5_000
_U = np.uint64
MEASURE = linking.Measure(shingle_set, linking.AtLeast(PERCENT))


def _bands(limit: int = 1 << 31) -> list[int]:
    """Lower ends of the size bands, each a third above the one before."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, -(-out[-1] * 4 // 3)))
    return out


BANDS = np.array(_bands())


def roles(n: int) -> list[tuple[int, int, int]]:
    """Band, segments and number of segments needed, for each band a set of ``n`` shingles is indexed in.

    It meets sets of its own band and larger ones in its band, smaller ones in theirs.
    """
    own = int(np.searchsorted(BANDS, n, side="right")) - 1
    out = []
    for band in range(int(np.searchsorted(BANDS, -(-3 * n // 4), side="right")) - 1, own + 1):
        top = int(BANDS[band + 1]) - 1
        segments = 2 * ((top + top * 4 // 3) // 7 + 1)
        needed = ((n + n * 4 // 3) if band == own else (top + n)) // 7 + 1
        out.append((band, segments, needed))
    return out


def _common(signatures: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(signatures), dtype=bool)
    at = np.minimum(np.searchsorted(common, signatures), len(common) - 1)
    return common[at] == signatures


def _signatures(s: np.ndarray, band: int, segments: int, needed: int, common: np.ndarray, every: bool = False) -> np.ndarray:
    """Index entries of the set ``s`` in a band.

    Let D < ``needed`` be the shingles in which two similar sets differ.

    1. The first ``needed`` uncommon segments, if there are as many. One of them is the same in the
       other set, which has it too: in case 1 because of the two the shorter prefix lies in the other,
       in cases 2 and 3 because these hold all uncommon segments.
    2. Otherwise all uncommon segments and all uncommon segments less one shingle. A segment counts for
       two if it and all it becomes by losing a shingle are uncommon and not empty. If these counts
       reach ``needed``, in some segment the other set is the same or differs by one shingle within
       what both hold (the other being in case 2 or 3).
    3. Otherwise these and the first ``needed`` segments, common or not; two sets of this case agree in
       one of them. Is that more than there are, all shingles too: similar sets share one.
    """
    segment, tokens = ((s >> _U(32)) * _U(segments)) >> _U(32), mix(s)  # of sorted shingles the segments are sorted too
    start = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    sums = np.add.reduceat(tokens, start)
    place = mix(segment[start] + _U(band << 40))
    exact = mix(sums ^ place)
    if every:
        return exact
    common_ = _common(exact, common)
    so_far = np.cumsum(~common_)
    if so_far[-1] >= needed:
        cut = int(np.searchsorted(so_far, needed)) + 1
        return exact[:cut][~common_[:cut]]
    size = np.diff(np.r_[start, len(s)])
    owner = np.repeat(np.arange(len(start)), size)
    less = mix((sums[owner] - tokens) ^ place[owner])
    usable = (size[owner] > 1) & ~_common(less, common)
    twice = ~common_ & (np.bincount(owner, weights=~usable, minlength=len(start)) == 0)
    out = [exact[~common_], less[usable]]
    if int((~common_).sum() + twice.sum()) < needed:
        out.append(exact[:needed][common_[:needed]])
        if len(exact) < needed:
            out.append(mix(tokens ^ _U((band << 40) + (1 << 39))))
    return np.concatenate(out)


def _profile(s: np.ndarray) -> np.ndarray:
    """Counts of the shingles by hash value, a power of two of them: of sets alike in size one has at most twice as many."""
    size = PROFILE
    while size * PROFILE_SHINGLES < len(s):
        size *= 2
    return np.minimum(np.bincount((s >> _U(32)).astype(np.int64) % size, minlength=size), 127).astype(np.int8)


#: Entries as blobs: four bytes of each signature, eight of each class key. Other rows describe documents.
PACKED = "part long, signatures binary, keys binary, common boolean, doc_id long, body long, n long, key long, profile array<tinyint>"
PACKED_SCHEMA = pa.schema(
    [("part", pa.int64()), ("signatures", pa.binary()), ("keys", pa.binary()), ("common", pa.bool_()), ("doc_id", pa.int64()), ("body", pa.int64()), ("n", pa.int64()), ("key", pa.int64())]
    + [("profile", pa.list_(pa.int8()))]
)


def _blobs(signatures: list[np.ndarray], owners: list[int], common: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each part and kind: few rows, whatever the number of signatures.

    The holders of a signature that is common in the sample are dealt over ``SPREAD`` parts.
    """
    keys = np.repeat(np.array(owners, dtype=np.int64), [len(x) for x in signatures])
    whole = np.concatenate(signatures)
    often = _common(whole, common)
    part = (whole & _U(0xFFFFFFFF)) + np.where(often, mix(keys.view(_U)) % _U(SPREAD), _U(0))
    slot = (part % _U(parts)).astype(np.int64) * 2 + often
    order = np.argsort(slot, kind="stable")
    slot, four, keys = slot[order], (whole[order] >> _U(32)).astype("<u4"), keys[order]
    ends = np.flatnonzero(np.r_[slot[1:] != slot[:-1], True]) + 1
    starts = np.r_[0, ends[:-1]]
    nothing = [None] * len(ends)
    columns = [
        (slot[starts] // 2).tolist(),
        [four[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
        [keys[a:b].tobytes() for a, b in zip(starts, ends, strict=True)],
        (slot[starts] % 2 == 1).tolist(),
        *[nothing] * 5,
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PACKED_SCHEMA.types, strict=True)], schema=PACKED_SCHEMA)


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows["signatures"].to_pylist()), dtype="<u4"), np.frombuffer(b"".join(rows["keys"].to_pylist()), dtype=np.int64)


def _common_segments(docs: DataFrame, count: int, size: int) -> np.ndarray:
    """Sorted signatures of segments that are common among a sample of the documents."""
    wanted = max(COMMON_LEAST, count // COMMON_ONE_IN)
    share = min(1.0, wanted / max(1, count))
    parts = max(1, -(-int(2 * share * size / SHINGLE_BYTES) // PART_SIGNATURES))
    sample = docs.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "body"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, dtype=_U)
        for batch in batches:
            sets = [s for s in map(shingle_set, batch["text"].to_pylist()) if len(s)]
            if not sets:
                continue
            found = np.concatenate([_signatures(s, *role, nothing, every=True) for s in sets for role in roles(len(s))])
            part = (found % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.flatnonzero(np.r_[np.diff(part[order]) != 0, True]) + 1
            starts = np.r_[0, ends[:-1]]
            blobs = [found[order[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[order[starts]]), pa.array(blobs, pa.binary())], ["part", "signatures"])

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        value, n = np.unique(np.frombuffer(b"".join(rows["signatures"]), dtype=_U), return_counts=True)
        often = n >= COMMON_TIMES
        return pd.DataFrame({"signature": value[often].view(np.int64), "n": n[often]})

    found = sample.mapInArrow(signed, "part long, signatures binary").groupBy("part").applyInPandas(counted, "signature long, n long")
    top = found.orderBy(F.desc("n"), "signature").limit(COMMON_MAX).select("signature").toPandas()
    return np.sort(top["signature"].to_numpy(dtype=np.int64).view(_U))


FOUND = "bucket long, members array<long>, weight long, long boolean, doc_id long, body long, n long, key long, profile array<tinyint>"
FOUND_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("members", pa.list_(pa.int64())), ("weight", pa.int64()), ("long", pa.bool_()), ("doc_id", pa.int64()), ("body", pa.int64()), ("n", pa.int64()), ("key", pa.int64())]
    + [("profile", pa.list_(pa.int8()))]
)
BUCKET = ["bucket", "members", "weight", "long"]
ABOUT = ["doc_id", "body", "n", "key", "profile"]


def _indexed(docs: DataFrame, common: np.ndarray, parts: int) -> DataFrame:
    """Rows of two kinds, from one reading of the texts.

    One describes a document: doc_id, body, n, key, profile (counts of its shingles by PROFILE hash
    values; of copies in one task the first has it). The other is a bucket: members (class keys under
    one signature, two at least), weight (signatures with the same members) and whether it is long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)  # COMMON_MAX numbers at most

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = shared.value, set()
        signatures, owners, held = [], [], 0
        for batch in batches:
            n, keys, profiles = [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text)
                key = class_key(s) if len(s) else 0
                n.append(len(s))
                keys.append(key)
                new = len(s) and key not in seen
                profiles.append(_profile(s) if new else None)
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    for role in roles(len(s)):
                        found = _signatures(s, *role, common)
                        signatures.append(found)
                        owners.append(key)
                        held += len(found)
            count = len(n)
            part = [k % parts for k in keys]
            about = [part, [None] * count, [None] * count, [None] * count, batch["doc_id"], batch["body"], n, keys, profiles]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(about, PACKED_SCHEMA.types, strict=True)], schema=PACKED_SCHEMA)
            if held >= PART_SIGNATURES:
                yield _blobs(signatures, owners, common, parts)
                signatures, owners, held = [], [], 0
        if held:
            yield _blobs(signatures, owners, common, parts)

    def gathered(rows: pa.Table) -> pa.Table:
        entry = rows["signatures"].is_valid()
        about = rows.filter(pc.invert(entry)).select(ABOUT)
        out = [about]
        for often in (False, True):
            chosen = rows.filter(pc.and_(entry, pc.equal(rows["common"], often)))
            if chosen.num_rows:
                out.append(_buckets(*_unpacked(chosen), often))
        whole = pa.concat_tables(out, promote_options="default")
        return pa.table([whole[f.name] if f.name in whole.column_names else pa.nulls(whole.num_rows, f.type) for f in FOUND_SCHEMA], schema=FOUND_SCHEMA)

    return docs.mapInArrow(signed, PACKED).groupBy("part").applyInArrow(gathered, FOUND)


def _buckets(signatures: np.ndarray, keys: np.ndarray, often: bool) -> pa.Table:
    """Rows of at most ``CHUNK`` members and their head; a bucket of several rows, or of several parts, is long."""
    if not often:  # most signatures have one holder
        order = np.argsort(signatures)
        same = signatures[order[1:]] == signatures[order[:-1]]
        order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
        signatures, keys = signatures[order], keys[order]
    rank = mix(keys.view(_U))  # the same order of sets in all buckets
    order = np.lexsort((rank, signatures))
    signatures, keys, rank = signatures[order], keys[order], rank[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (signatures[1:] != signatures[:-1]) | (keys[1:] != keys[:-1])
    signatures, keys, rank = signatures[new], keys[new], rank[new]
    start = np.flatnonzero(np.r_[True, signatures[1:] != signatures[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[start, len(keys)])
    some = np.flatnonzero(size > (0 if often else 1))  # of a spread bucket the rest lies in other parts
    if often or not len(some):
        first, weight = np.arange(len(some)), np.ones(len(some), dtype=np.int64)
    else:
        sums, sizes = np.add.reduceat(mix(rank), start)[some], size[some]
        order = np.lexsort((sizes, sums))
        begin = np.flatnonzero(np.r_[True, (sums[order[1:]] != sums[order[:-1]]) | (sizes[order[1:]] != sizes[order[:-1]])])
        first, weight = order[begin], np.diff(np.r_[begin, len(order)])
    out = []
    for k, w in zip(some[first], weight, strict=True):
        members = keys[start[k] : start[k] + size[k]]
        is_long = often or len(members) > linking.SMALL_LIST
        for a in range(1, max(2, len(members)), CHUNK):  # the head leads every row
            out.append((int(signatures[start[k]]), np.r_[members[:1], members[a : a + CHUNK]], int(w), is_long))
    columns = zip(*out, strict=True) if out else ((),) * 4
    return pa.table([pa.array(list(c), FOUND_SCHEMA.field(name).type) for c, name in zip(columns, BUCKET, strict=True)], names=BUCKET)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that may be similar by sizes and profiles, which never differ by more than the sets do."""
    x = classes.select(F.col("key").alias("a"), F.col("n").alias("m"), F.col("profile").alias("p"))
    y = classes.select(F.col("key").alias("b"), "n", F.col("profile").alias("q"))
    sizes = (4 * F.col("m") >= 3 * F.col("n")) & (4 * F.col("n") >= 3 * F.col("m"))
    pairs = pairs.join(x.drop("p"), "a").join(y.drop("q"), "b").filter(sizes).select("a", "b")

    def folded(p: str, q: str) -> Column:
        """The counts of the first in as many numbers as the second has, where it has twice as many."""
        half = F.size(q)
        return F.when(F.size(p) > half, F.zip_with(F.slice(p, F.lit(1), half), F.slice(p, half + 1, half), lambda a, b: a.cast("int") + b.cast("int"))).otherwise(F.col(p).cast("array<int>"))

    apart = F.aggregate(F.zip_with(folded("p", "q"), folded("q", "p"), lambda p, q: F.abs(p - q)), F.lit(0), lambda total, d: total + d)
    held = pairs.join(x, "a").join(y, "b")
    return held.filter(7 * apart <= F.col("m") + F.col("n")).select("a", "b")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Words are runs of other than ASCII white space with A-Z in lower case; a set holds the distinct
    runs of five words, of a shorter text all its words as one. Sets link at similarity 0.75 or more;
    component_id is the smallest doc_id that links reach. A null or empty text has no shingles and is a
    component of its own, also where such rows repeat. Rows that repeat a doc_id are linked by their
    texts like others; null doc_ids are never a component_id where the component has another. Other
    columns are dropped; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = linking.keyed(docs, doc_id, text)
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    common = _common_segments(docs, size["rows"], size["bytes"] or 0)
    parts = max(1, -(-int(2 * (size["bytes"] or 0) / (3 * SHINGLE_BYTES)) // PART_SIGNATURES))
    indexed = materialize(_indexed(docs, common, parts), "indexed")
    rows = indexed.filter("n IS NOT NULL").select(*ABOUT)
    full = rows.filter("n > 0")
    by_key = full.groupBy("key").agg(linking.first_row(), F.max("n").alias("n"))
    profiles = full.filter("profile IS NOT NULL").groupBy("key").agg(F.first("profile").alias("profile"))
    classes = materialize(by_key.join(profiles, "key"), "classes")
    repeated = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    buckets = indexed.filter("members IS NOT NULL").select(*BUCKET)
    agreeing = buckets.select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, CHUNK)).alias("b"), "weight")
    agreeing = agreeing.groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    short = buckets.filter("NOT long").select("members").distinct()
    long = buckets.filter("long").select("bucket", F.explode("members").alias("key")).distinct()
    label = linking.links(docs, classes, agreeing, short, long, lambda pairs: _likely(pairs, classes), MEASURE, repeated)
    return linking.component_rows(rows, classes, label)


def near_duplicates_dropped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the first document of each component; rows without words all stay, so do null ids.

    Rows that repeat an id count as one document, which stays if one of them is first in its component.
    """
    found = jaccard_components(docs, doc_id, text).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("doc_id = component_id")).alias("stays"))
    gone = free_name(docs, "gone")
    dropped = materialize(found.filter("NOT stays").select(F.col("doc_id").alias(gone)), "gone")
    return docs.join(dropped, F.col(f"`{doc_id}`") == F.col(gone), "left_anti")
