"""N-gram Jaccard self-join over prefix trees, to components of linked texts."""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import golomb
from .components import components
from .store import drop, durable, restrict, shards
from .textkit import U64, byte_hashes, chunks, lower, mix, ngram_hashes, ragged, run_hashes, words

#: n-grams of one packet and of one owner in the exchange of their counts, about.
PACKET = 128_000
PER_OWNER = 4_000_000
#: Bytes of n-gram sets, and texts, that one task joins at a time, about.
BLOCK_BYTES = 8 << 20
BLOCK_TEXTS = 100
#: An n-gram is hot if more prefixes than this have it, and more than their number over HOT_KEYS.
HOT, HOT_KEYS = 2000, 250_000
_FEW = U64(0x5D1C7A3B9E2F4861)


def _sets(column, n: int):
    """(first row, list of arrays): the sorted distinct n-gram hashes of each text."""
    for a, b, data, offsets in chunks(column):
        data = lower(data)
        starts, ends, first = words(data, offsets)
        hashes = byte_hashes(data, starts, ends)
        grams = ngram_hashes(hashes, n)
        short = [k for k in range(b - a) if 0 < first[k + 1] - first[k] < n]
        if short:
            whole = mix(run_hashes(hashes, first[:-1][short], first[1:][short]) ^ _FEW)
            few = dict(zip(short, whole, strict=True))
        out = []
        for k in range(b - a):
            x, y = int(first[k]), int(first[k + 1])
            out.append(np.unique(grams[x : y - n + 1]) if y - x >= n else np.array([few[k]] if y > x else [], U64))
        yield a, out


def _signatures(n: int):
    def signatures(batches):
        for batch in batches:
            size, lo, hi = [], [], []
            for _, sets in _sets(batch.column(1), n):
                for s in sets:
                    size.append(len(s))
                    lo.append(int(np.bitwise_xor.reduce(s)) if len(s) else 0)
                    hi.append(int(mix(s ^ _FEW).sum()) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(lo, U64).view(np.int64)), pa.array(np.array(hi, U64).view(np.int64))], ["id", "n", "lo", "hi"])

    return signatures


def _counted(grams: np.ndarray) -> np.ndarray:
    """Whether n-grams stand in the half of the order that is counted; it comes first."""
    return grams & U64(1) == U64(0)


def _packets(n: int, num: int, den: int):
    """Rows of about PACKET n-grams: the counted ones of each set, and the least of the others where the prefix needs them."""

    def packets(batches):
        ids, sizes, lengths, grams, total, made = [], [], [], [], 0, count()

        def row():
            name = TaskContext.get().partitionId() << 32 | next(made)
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), *(pa.array([x], pa.list_(pa.int64())) for x in (ids, sizes, lengths)), pa.array([np.concatenate(grams).tobytes()], pa.large_binary()).cast(pa.binary())],
                ["packet", "ids", "sizes", "lengths", "grams"],
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, sets in _sets(batch.column(1), n):
                for k, s in enumerate(sets):
                    m, own = len(s), _counted(s)
                    more = s[~own][: max(0, m - -(-num * m // den) + 1 - int(own.sum()))]
                    ids.append(names[a + k])
                    sizes.append(m)
                    grams.append(np.concatenate([s[own], more]))
                    lengths.append(len(grams[-1]))
                    total += lengths[-1]
                    if total >= PACKET:
                        yield row()
                        ids, sizes, lengths, grams, total = [], [], [], [], 0
        if ids:
            yield row()

    return packets


def _values(grams: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct counted n-grams of a packet, cut to their first bits, and how many of its sets hold each."""
    g = np.frombuffer(grams, U64)
    return np.unique(g[_counted(g)] >> U64(64 - bits), return_counts=True)


def _send(bits: int, owners: int):
    def send(batches):
        for batch in batches:
            for packet, grams in zip(batch.column("packet").to_pylist(), batch.column("grams"), strict=True):
                values, counts = _values(grams.as_py(), bits)
                to = ((values >> U64(bits - 24)) * U64(owners) >> U64(24)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(values)] if len(values) else [0]
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                sent = [golomb.encode(values[a:b]) for a, b in spans]
                often = [zlib.compress(counts[a:b].astype(np.uint32).tobytes(), 1) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in spans], pa.int32()), pa.array([packet] * len(spans), pa.int64()), pa.array(sent, pa.binary()), pa.array(often, pa.binary())], ["owner", "packet", "sent", "often"])

    return send


def _answer(table: pa.Table) -> pa.Table:
    """Of each list, the level of its values: 0 for those that one set holds, else by the logarithm of their number."""
    sent = [golomb.decode(x.as_py()) for x in table.column("sent")]
    often = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), np.uint32) for x in table.column("often")])
    _, at = np.unique(np.concatenate(sent), return_inverse=True)
    levels = np.minimum(255, np.ceil(4 * np.log2(np.bincount(at, weights=often)))).astype(np.uint8)[at]
    cuts = np.cumsum([0, *map(len, sent)])
    packed = [zlib.compress(levels[a:b].tobytes(), 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"packet": table.column("packet"), "owner": table.column("owner"), "levels": pa.array(packed, pa.binary())})


def _prefixes(num: int, den: int, bits: int):
    def prefixes(packets: pa.Table, answers: pa.Table) -> pa.Table:
        answers = sorted(zip(answers.column("owner").to_pylist(), answers.column("levels").to_pylist(), strict=True))
        levels = np.frombuffer(b"".join(zlib.decompress(x) for _, x in answers), np.uint8)
        ids, sizes, grams = [], [], [np.zeros(0, U64)]
        for k in range(packets.num_rows):
            values, _ = _values(packets.column("grams")[k].as_py(), bits)
            all_grams, at = np.frombuffer(packets.column("grams")[k].as_py(), U64), 0
            for name, m, length in zip(*(packets.column(c)[k].as_py() for c in ("ids", "sizes", "lengths")), strict=True):
                g = all_grams[at : at + length]
                at += length
                own = _counted(g)
                level = np.full(length, 256, np.int64)  # not counted: after all the others
                level[own] = levels[np.searchsorted(values, g[own] >> U64(64 - bits))]
                first = np.lexsort((g, level))[: m - -(-num * m // den) + 1]
                first = first[level[first] > 0]  # an n-gram of one set joins it with nothing
                grams.append(g[first])
                ids += [name] * len(first)
                sizes += [m] * len(first)
        return pa.table({"gram": np.concatenate(grams).view(np.int64), "id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64())})

    return prefixes


def _packed(n: int):
    def packed(batches):
        for batch in batches:
            sets = [s.tobytes() for _, some in _sets(batch.column("text"), n) for s in some]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "grams"])

    return packed


def trie_links(probes: list[np.ndarray], stored: list[np.ndarray], probe_labels: list[int], labels: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links (probe label, stored label) that suffice to join all texts whose sets have Jaccard >= num/den.

    The probes stand in a prefix tree in one order of n-grams. A walk down the tree keeps the overlap of
    the path with every stored set, so probes that share a path share its overlaps; a subtree is left
    when no stored set of another component can reach its required overlap with what may remain.
    """
    if not probes or not stored:
        return []
    values, codes, often = np.unique(np.concatenate([*probes, *stored]), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(values))  # the most shared first, so that paths are shared
    codes = rank[codes]
    cuts = np.cumsum([0, *map(len, probes), *map(len, stored)])
    paths = [np.sort(codes[a:b]) for a, b in zip(cuts[: len(probes)], cuts[1:], strict=False)]
    owner = np.repeat(np.arange(len(stored)), [len(s) for s in stored])
    own = codes[cuts[len(probes)] :]
    by = np.argsort(own, kind="stable")
    owner, lists = owner[by], np.searchsorted(own[by], np.arange(len(values) + 1))
    sizes = np.array([len(s) for s in stored], np.int64)
    names, at = np.unique([*labels, *probe_labels], return_inverse=True)
    comp = np.arange(len(names))  # of each label
    stored_at, probe_at = at[: len(labels)], at[len(labels) :]
    order = sorted(range(len(paths)), key=lambda k: paths[k].tolist())
    lengths, probe_at = np.array([len(paths[k]) for k in order]), probe_at[order]
    common = np.zeros(len(order) + 1, np.int64)  # of each path with the one before
    for k in range(1, len(order)):
        x, y = paths[order[k - 1]], paths[order[k]]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        common[k] = differ[0] if len(differ) else m

    def overlaps(path: np.ndarray) -> np.ndarray:
        return np.bincount(owner[ragged(lists[path], lists[path + 1] - lists[path])], minlength=len(sizes))

    links, stack = [], [(0, len(order), 0, np.zeros(len(sizes), np.int64))]
    while stack:
        lo, hi, depth, seen = stack.pop()
        longest, shortest = lengths[lo:hi].max(), lengths[lo:hi].min()
        here = comp[probe_at[lo:hi]]
        other = comp[stored_at] != here[0] if (here == here[0]).all() else True
        least = -(-num * (shortest + sizes) // (num + den))
        if not ((seen + (longest - depth) >= least) & (sizes * den >= shortest * num) & (sizes * num <= longest * den) & other).any():
            continue
        if hi - lo == 1:
            total = seen + overlaps(paths[order[lo]][depth:])
            for j in np.flatnonzero((den * total >= num * (sizes + longest - total)) & other).tolist():
                x, y = comp[probe_at[lo]], comp[stored_at[j]]
                if x != y:
                    links.append((int(names[probe_at[lo]]), int(names[stored_at[j]])))
                    comp[comp == y] = x
            continue
        shared = int(common[lo + 1 : hi].min())
        if shared > depth:
            seen = seen + overlaps(paths[order[lo]][depth:shared])
        starts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == shared)).tolist(), hi]
        stack += [(a, b, shared, seen) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return links


def _join(num: int, den: int):
    def join(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_py(), U64) for x in table.column("grams")]
        labels, roles = table.column("label").to_pylist(), table.column("role").to_pylist()
        kept = [k for k, r in enumerate(roles) if r != 1]
        ask = [k for k, r in enumerate(roles) if r == 1] if 1 in roles else kept
        links = trie_links([sets[k] for k in ask], [sets[k] for k in kept], [labels[k] for k in ask], [labels[k] for k in kept], num, den)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return join


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that it reaches by links).

    A text's set has its distinct n-word shingles (A-Z lower-cased, words split at ASCII white space);
    with fewer words, the whole sequence is the one shingle. Two texts link when den * |intersection| >=
    num * |union|. Null and empty texts have an empty set and link with nothing: their component is their
    own id. Repeated rows each come back, and rows
    that share an id count as one document for links; a null id takes its copies' component (null if it has none).
    An empty table gives an empty result; other columns are not looked at. Ids are integers. Sets are of
    64-bit hashes, so two different shingles count as one with probability 2**-64 a pair.

    Equal sets are one class first. The n-grams of all classes have one order: those of a half that is
    counted exactly over the whole corpus (an exchange of Golomb-coded fingerprints) by their number, rarest
    first, then the others. Sets that link share one of the first n-grams of each (its prefix) and have like
    sizes, so classes that share neither are never compared, and n-grams of a single class route nothing.
    Classes that do are linked to the least class with that n-gram and size, never in pairs, and what is
    linked is a block. A block of usual size is joined in a prefix tree by one task. A larger one is dealt to
    parts, the classes that many others were linked to going to all of them; then the classes outside the block's
    largest component, and only those, are compared with every part, or, where that costs less (many such classes), with
    the classes that share an n-gram of their prefix and have like sizes, list by list, a long list in parts.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    table = durable(docs.mapInArrow(_signatures(n), "id long, n long, lo long, hi long"), "signatures")
    classes = durable(table.where("n > 0").groupBy("n", "lo", "hi").agg(F.min("id").alias("rep")).where("rep is not null"), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits, owners = min(64, max(32, int(total).bit_length() + 8)), shards(spark, total / 2, PER_OWNER)
    reps = restrict(docs, classes.select(F.col("rep").alias("id")), "id")
    packets = durable(reps.mapInArrow(_packets(n, num, den), "packet long, ids array<long>, sizes array<long>, lengths array<long>, grams binary"), "packets")
    sent = packets.select("packet", "grams").mapInArrow(_send(bits, owners), "owner int, packet long, sent binary, often binary")
    levels = sent.groupBy("owner").applyInArrow(_answer, "packet long, owner int, levels binary")
    routes = packets.groupBy("packet").cogroup(levels.groupBy("packet")).applyInArrow(_prefixes(num, den, bits), "gram long, id long, n long")
    routes = durable(routes.withColumn("size", F.floor(F.log("n") / np.log(den / num)).cast("int")), "routes")  # sizes of links are equal or neighbours

    hubs = routes.groupBy("gram", "size").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count("*").alias("rows"))
    hubs = durable(hubs, "hubs")
    below = hubs.select("gram", (F.col("size") + 1).alias("size"), F.col("hub").alias("id"))
    several = hubs.where("hub < top")
    hot = several.where(F.col("rows") > max(HOT, routes.count() // HOT_KEYS)).select("gram", "size", "hub")  # HOT_KEYS rows at most, so their routes stay where they are
    cool = several.join(F.broadcast(hot.select("gram", "size")), ["gram", "size"], "left_anti")
    rest = routes.join(F.broadcast(hot.select("gram", "size")), ["gram", "size"], "left_anti")
    stars = routes.join(F.broadcast(hot), ["gram", "size"]).select("id", "hub").union(rest.join(cool, ["gram", "size"]).select("id", "hub")).where("id <> hub")
    candidates = durable(stars.union(hubs.join(below, ["gram", "size"]).where("id <> hub").select("id", "hub")).distinct(), "candidates")
    chained = components(candidates)
    blocks = durable(chained.toDF("id", "block"), "blocks")
    drop(chained)
    sizes = classes.select(F.col("rep").alias("id"), "n")
    weighed = blocks.join(sizes, "id").groupBy("block").agg(F.ceil(F.greatest(F.sum("n") * 8 / BLOCK_BYTES, F.count("*") / BLOCK_TEXTS)).cast("int").alias("subs"))
    often = candidates.groupBy("hub").count().where(f"count >= {BLOCK_TEXTS}").selectExpr("hub as id", "true as everywhere")
    members = blocks.join(weighed, "block").join(often, "id", "left").select("id", "block", "subs", (F.col("everywhere").isNotNull() | (F.col("id") == F.col("block"))).alias("everywhere"))
    members = durable(members, "members")
    own = "array(cast(pmod(xxhash64(id), subs) as int))"

    def linked(rows: DataFrame, ids: DataFrame, sub: str, turn: str) -> DataFrame:
        sets = restrict(docs, ids, "id").mapInArrow(_packed(n), "id long, grams binary")
        rows = rows.selectExpr("*", f"{sub} as sub").selectExpr("*", f"{turn} as turn")
        return rows.join(sets, "id").groupBy("block", "sub", "turn").applyInArrow(_join(num, den), "a long, b long")

    alone = members.selectExpr("id", "block", "id as label", "subs", "0 as role", "1 as turns", "everywhere")
    links = durable(linked(alone, members.select("id"), f"explode(if(everywhere, sequence(0, subs - 1), {own}))", "0"), "links")
    found = components(links)
    over = [packets, hubs, candidates, blocks]  # tables that nothing reads any more
    split = members.where("subs > 1")
    if not split.isEmpty():
        split = durable(split.join(found, split.id == found.node, "left").select("id", "block", "subs", F.coalesce("component", "id").alias("label")), "split")
        largest = split.groupBy("block", "label").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
        asked = durable(split.join(largest, "block").select("id", "block", "subs", "label", (F.col("label") != F.col("top")).cast("int").alias("ask")), "asked")
        turns = F.ceil(F.col("asks") / BLOCK_TEXTS).cast("int").alias("turns")
        large = durable(asked.groupBy("block", "subs").agg(F.count("*").alias("texts"), F.sum("ask").alias("asks")).where("asks > 0").select("*", turns), "large")
        both = asked.join(large.select("block", "turns"), "block")
        crowded = large.where("turns > 1")
        if not crowded.isEmpty():  # lists cost less than all parts of the block
            listed = routes.join(asked.join(crowded.select("block"), "block", "left_semi").drop("subs"), "id").selectExpr("gram", "id", "n", "block", "label", "ask", "explode(array(size - 1, size)) as band")
            listed = durable(listed, "listed")
            lists = listed.groupBy("gram", "band").agg(F.min("block").alias("block"), F.count("*").alias("texts"), F.sum("n").alias("grams"), F.sum("ask").alias("asks"), F.min("label").alias("low"), F.max("label").alias("high"))
            lists = lists.where("asks > 0 and low < high").select("gram", "band", "block", "texts", "asks", turns, F.ceil(F.greatest(F.col("grams") * 8 / BLOCK_BYTES, F.col("texts") / BLOCK_TEXTS)).cast("int").alias("subs"))
            costs = lists.groupBy("block").agg(F.sum(F.expr("texts * turns + asks * subs")).alias("cost"))
            cheap = durable(crowded.join(costs, "block", "left").where("coalesce(cost, 0) < asks * subs + texts * turns").select("block"), "cheap")
            lists = lists.join(cheap, "block", "left_semi").select("gram", "band", "subs", "turns")
            rows = listed.join(lists, ["gram", "band"]).select("id", F.xxhash64("gram", "band").alias("block"), "subs", "label", "ask", "turns")
            both = both.join(cheap, "block", "left_anti").unionByName(rows)
        both = durable(both.withColumn("role", F.explode(F.when(F.col("ask") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("ask"), "both")
        more = linked(both, both.select("id").distinct(), f"explode(if(role = 1, sequence(0, subs - 1), {own}))", "explode(if(role = 1, array(cast(pmod(xxhash64(id, 1), turns) as int)), sequence(0, turns - 1)))")
        all_links = durable(links.union(more), "links")
        found = components(all_links)
        over += [split, asked, large, both, all_links]
    for gone in [*over, routes, members, links]:
        drop(gone)
    heads = classes.join(found, classes.rep == found.node, "left").select("n", "lo", "hi", F.coalesce("component", "rep").alias("component_id"))
    out = table.join(heads, ["n", "lo", "hi"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
