import contextlib
import os
import random
import threading

import corpus_pipeline as c
from pyspark.sql import functions as F

from memlake.llm import parity_join
from memlake.llm.common import release, shared_dir


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and", "that", "house", "river", "stone", "green"]) for _ in range(n))


def test_stages_on_very_long_texts_and_clashing_columns(spark):
    long = words(60_000, 1)
    rows = [(1, long), (2, long + "  "), (3, words(60_000, 2)), (4, "short words of the house"), (5, words(400, 3)), (6, words(400, 3) + " end")]
    base = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["row", "sha", "id", "no_id", "n", "key", "cuts", "at", "ids", "bucket", "mix_", "component_id", "digest", "host"]
    docs = base.withColumns({name: F.lit(i) for i, name in enumerate(names)})
    frame = docs
    for _, stage in c.STAGES[:-1]:
        frame = stage(spark, frame, "")
        assert frame.columns == docs.columns
    once = c.without_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in once.collect()) == [2, 3, 4, 5, 6]  # of two equal texts the longer
    assert sorted(r["doc_id"] for r in c.without_near_copies(spark, once, "").collect()) == [2, 3, 4, 5]
    coded = c.tokens(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in coded) == [1, 2, 3, 4, 5, 6] and all(r["n_tokens"] > 0 for r in coded)


def lies(folder):
    """Bytes of all files below a folder; files may go meanwhile."""
    total = 0
    for d, _, names in os.walk(folder):
        for name in names:
            with contextlib.suppress(OSError):
                total += os.lstat(f"{d}/{name}").st_size
    return total


def test_near_copies_leave_little_on_disk(spark, monkeypatch):
    """Long texts that share a passage, but no near copies: what lies in the shared folder and in shuffles stays under 1.8 times the texts, with the joins of large tables."""
    for name, value in {"BROADCAST_IDS": 0, "LARGE": 1}.items():
        monkeypatch.setattr(parity_join, name, value)
    rng = random.Random(5)
    passage = " ".join(f"{rng.randrange(1 << 40):x}" for _ in range(300))
    texts = [passage + " " + " ".join(f"{rng.randrange(1 << 24):x}" for _ in range(1_500 + i)) for i in range(300)]
    rows = [*enumerate(texts), (300, texts[7] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    local = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    places, most, over = [*local, shared_dir(spark).removeprefix("file:")], 0, threading.Event()
    release(spark)
    before = sum(map(lies, places))

    def watch():
        nonlocal most
        while not over.wait(0.05):
            most = max(most, sum(map(lies, places)) - before)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        got = c.without_near_copies(spark, docs, "").select("doc_id").collect()
    finally:
        over.set()
        thread.join()
    assert sorted(r["doc_id"] for r in got) == [*range(300)]
    assert most < 1.8 * sum(len(t) for _, t in rows), most / sum(len(t) for _, t in rows)
