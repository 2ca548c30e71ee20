"""Spelling variants: words one edit apart, by a dictionary of trie-node pairs.

All words stand in two tries, one read forwards and one backwards. Each trie node gets an integer, so a place in a
word is a pair: the node of the letters before it and the node of the letters behind it.

* A skipped position ``i`` is the pair (letters before ``i``, letters after ``i``). Words that share one differ
  in exactly that letter.
* An inserted position ``i`` is the pair (letters before ``i``, letters from ``i`` on). A word that has one
  where another word has a skipped position is the other one without that letter.

One grouping by pairs therefore finds all exact neighbours, at a cost linear in the letters of the vocabulary. A group holds
one word for each letter that fits the place, and one without it; it is counted with window functions and never paired.
Of a run of equal letters only the last one is skipped against inserted positions, so no neighbour counts twice.

Nodes are numbered in tasks over the sorted words: a word shares the nodes of its common prefix with the word before it and
opens new ones for the rest. Where a prefix runs over the border of two tasks, the later task's nodes are
replaced by those of the earlier one; only the words at the borders (two for each task) pass through the driver. Nodes
that belong to one word alone cannot match, so they are left out of the pairs.

Defined results: null and empty texts have no words; a null ``doc_id`` reads ``null`` where the planted typos use it; repeated
rows are counted each; ties of forms go to the word that is first by code points; other columns are ignored; an empty
table gives an empty result. Words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.tasks import column, ship_functions, slices
from panelspark.session import settle

LEAST_LETTERS = 5
LEAST_COUNT = 3
FORM_FACTOR = 2
_RUN = re.compile("[a-zÀ-ÿ]+")
# Entries and letters that a task counts before it hands them on.
_COUNTED, _COUNTED_LETTERS = 1 << 17, 8 << 20


def _counts(typo_every: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        letters = 0
        for batch in slices(batches):
            for text, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                begin = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                # Lower case of bytes changes A-Z only.
                for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                    if typo_every:
                        h = zlib.crc32(word.encode(), begin)
                        if h % typo_every == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                    if len(word) >= least:
                        if word not in total:
                            letters += len(word)
                        total[word] += n
            if len(total) >= _COUNTED or letters >= _COUNTED_LETTERS:
                yield pa.record_batch([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                total, letters = Counter(), 0
        if total:
            yield pa.record_batch([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return run


def count_words(docs: DataFrame, typo_every: int = 0) -> DataFrame:
    """``word, n``: words of Latin letters with at least ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences.

    ``typo_every`` deletes one letter of every word of a document for which it divides the checksum of id and word.
    """
    ship_functions(docs.sparkSession)
    scan = docs.select(column(docs, "text").alias("text"), column(docs, "doc_id").cast("string").alias("doc_id"))
    counted = scan.mapInArrow(_counts(typo_every, LEAST_LETTERS), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _common(a: str, b: str) -> int:
    """Letters that two words have in common at their beginning."""
    if a[:32] != b[:32]:
        k = 0
        for x, y in zip(a, b):
            if x != y:
                return k
            k += 1
        return k
    return len(commonprefix((a, b)))


_NODES = pa.list_(pa.int64())
_NUMBERED = "part int, lead int, shared int, node long, same array<boolean>, nodes array<long>"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the trie nodes of sorted words (column ``key``), with the other columns as they are.

    ``nodes`` has the nodes of the prefixes of 0 to ``shared`` letters, ``node`` is that of the whole word, and ``lead`` counts the letters in
    common with the task's first word. All prefixes of the first and last word count as shared, as the neighbour is unknown.
    ``same`` tells which letters equal the one before.
    """
    part = TaskContext.get().partitionId()
    opened, nodes, last, first, lead = part << 33, [], None, None, 0
    held = None  # the batch so far, of which the last word waits for the one behind it
    for batch in batches:
        if not batch.num_rows:
            continue
        out: list[tuple] = []
        keys = batch.column(0).to_pylist()
        for key in keys:
            if first is None:
                first, before, lead = key, -1, len(key)
            else:
                before = _common(last, key)
                lead = min(lead, before)  # sorted words drift away from the first one
            if held and held[1] is None:
                held = _close(held, before)
                yield _batch(*held[0])
            elif out:
                out[-1][2][0] = max(out[-1][2][0], before)
            nodes = nodes[: before + 1] + list(range(opened, opened + len(key) - before))
            opened += len(key) - before
            shared = [len(key) if before < 0 else before]
            out.append((lead, nodes[-1], shared, nodes, [a == b for a, b in zip(key[1:], key)]))
            last = key
        held = ((part, batch, out), None)
    if held:
        yield _batch(*_close(held, len(last))[0])


def _close(held: tuple, behind: int) -> tuple:
    """The last word of a batch learns how many letters the next word shares."""
    shared = held[0][2][-1][2]
    shared[0] = max(shared[0], behind)
    return held[0], True


def _batch(part: int, batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    own = [
        pa.array([part] * len(out), pa.int32()),
        pa.array([r[0] for r in out], pa.int32()),
        pa.array([r[2][0] for r in out], pa.int32()),
        pa.array([r[1] for r in out], pa.int64()),
        pa.array([[False, *r[4]] for r in out], pa.list_(pa.bool_())),
        pa.array([r[3][: r[2][0] + 1] for r in out], _NODES),
    ]
    names = ["part", "lead", "shared", "node", "same", "nodes"]
    return pa.record_batch([*own, *batch.columns], [*names, *batch.schema.names])


def number_nodes(words: DataFrame, name: str) -> DataFrame:
    """Words (column ``key``) with the numbers of their trie nodes, the same for equal prefixes in all tasks."""
    spark = words.sparkSession
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    local = settle(
        words.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_number, f"{_NUMBERED}, {kept}"), name
    )
    borders = (
        local.groupBy("part")
        .agg(F.min("key").alias("first"), F.max(F.struct("key", "nodes")).alias("last"))
        .orderBy("part").toLocalIterator()
    )
    before, known, replaced = None, [], []
    for row in borders:
        from_before = known[: _common(before, row.first) + 1] if before is not None else []
        replaced.append((row.part, from_before))
        inherited = min(len(from_before), _common(row.first, row.last.key) + 1)
        before, known = row.last.key, from_before[:inherited] + row.last.nodes[inherited:]
    table = spark.createDataFrame(replaced, "part int, earlier array<long>")
    return local.join(table, "part").withColumn(
        "nodes", F.expr("transform(nodes, (v, d) -> IF(d <= lead AND d < size(earlier), earlier[d], v))")
    )


def _places(low: str, high: str):
    return F.explode(F.when(F.expr(f"{low} <= {high}"), F.expr(f"sequence({low}, {high})")).otherwise(F.expr("array()")))


def pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, word, n`` of all words, and ``prefix, suffix, id, n, skipped, last``: their places as pairs of nodes.

    ``id`` grows with the code-point order of the words.
    """
    forward = number_nodes(words.select(F.col("word").alias("key"), "n"), "forward-trie")
    forward = forward.select(F.reverse("key").alias("key"), F.col("node").alias("id"), "n", F.col("nodes").alias("before"))
    both = settle(
        number_nodes(forward, "backward-trie").select(
            "id", "n", F.reverse("key").alias("word"), F.length("key").alias("size"), "before",
            F.col("nodes").alias("behind"), F.reverse("same").alias("same"),
        ),
        "trie-nodes",
    )
    reach = both.select(
        "id", "n", "size", "before", "behind", "same",
        (F.size("before") - 1).alias("far"), (F.size("behind") - 1).alias("back"),
    )
    skipped = reach.withColumn("i", _places("greatest(0, size - 1 - back)", "least(far, size - 1)")).selectExpr(
        "before[i] AS prefix", "behind[size - 1 - i] AS suffix", "id", "n", "true AS skipped", "NOT same[i] AS last"
    )
    inserted = reach.withColumn("i", _places("greatest(0, size - back)", "least(far, size)")).selectExpr(
        "before[i] AS prefix", "behind[size - i] AS suffix", "id", "n", "false AS skipped", "false AS last"
    )
    return both.select("id", "word", "n"), skipped.unionAll(inserted)


def _neighbours(found: DataFrame) -> DataFrame:
    """``id, n_near, best``: how many words are near, and the most frequent one as ``(n, -id)``."""
    group = Window.partitionBy("prefix", "suffix")
    word = F.struct(F.col("n"), (-F.col("id")).alias("minus_id"))
    skipped, last = F.col("skipped"), F.col("last")
    met = found.select(
        "id", "skipped", "last",
        F.count(F.when(skipped, 1)).over(group).alias("n_skipped"),
        F.count(F.when(last, 1)).over(group).alias("n_last"),
        F.count(F.when(~skipped, 1)).over(group).alias("n_inserted"),
        F.max(F.when(skipped, word)).over(group).alias("top_skipped"),
        F.max(F.when(last, word)).over(group).alias("top_last"),
        F.max(F.when(~skipped, word)).over(group).alias("top_inserted"),
    )
    # A word may be the most frequent one of its own group: then no other one there is twice as frequent.
    near = F.when(skipped, F.col("n_skipped") - 1 + F.when(last, F.col("n_inserted")).otherwise(0)).otherwise(F.col("n_last"))
    best = F.when(skipped, F.greatest("top_skipped", F.when(last, F.col("top_inserted")))).otherwise(F.col("top_last"))
    return (
        met.select("id", near.alias("n_near"), best.alias("best")).where("n_near > 0")
        .groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    )


def _roots(links: DataFrame) -> DataFrame:
    """``id, root`` of words with a form. Each step doubles the links followed; a chain has at most 63, as counts double."""
    followed = settle(links.select("id", F.col("form_id").alias("root")), "forms")
    while True:
        on = followed.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = followed.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        followed = settle(step, "forms")
        if followed.where("moved").isEmpty():
            return followed.select("id", "root")
        followed = followed.select("id", "root")


def group_variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table of distinct words with their counts ``n``.

    The form of a word is the most frequent of the words one edit away, if it occurs at least ``FORM_FACTOR``
    times as often; the root is the end of the chain of forms.
    """
    ship_functions(words.sparkSession)
    named, found = pairs(words)
    best = F.when(F.col("best.n") >= FORM_FACTOR * F.col("n"), F.col("best"))
    near = settle(
        named.join(_neighbours(found), "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            (-best["minus_id"]).alias("form_id"), best["n"].alias("form_n"),
        ),
        "near-words",
    )
    roots = _roots(near.where("form_id IS NOT NULL"))
    name = lambda key, out: near.select(F.col("id").alias(key), F.col("word").alias(out))
    return (
        near.join(roots, "id", "left")
        .join(name("form_id", "form"), "form_id", "left")
        .join(name("root", "root_word"), "root", "left")
        .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
    )
