"""What the training of the toxicity network takes of the driver's memory."""

import tracemalloc

import numpy as np

from lumenrv.llm import toxicity


def test_runs_of_many_words_are_hashed_some_thousand_at_a_time():
    words = [f"word{i * 7919}x" for i in range(60_000)]
    tracemalloc.start()
    flat, starts, sizes = toxicity.gram_ids(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * (flat.nbytes + starts.nbytes + sizes.nbytes)
    for i in (0, 19_999, 20_000, 59_999):
        alone = toxicity.gram_ids([words[i]])[0]
        assert np.array_equal(flat[starts[i] : starts[i] + sizes[i]], alone)


def test_the_sample_comes_as_one_document_after_the_other(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(i % 5 * 30))) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    sample = toxicity.labelled_windows(docs, labels, each=2000, most=1000, window=64, stride=48)
    assert iter(sample) is sample  # a list of all windows would be held beside the arrays
    kept = [(w[0].split("x")[0], [len(x.split(" ")) for x in w], y) for w, y in sample]
    ids = spark.range(200).filter(~toxicity.held_out(toxicity.F.col("id")) & toxicity.F.expr("id % 5 > 0")).orderBy("id").collect()
    sizes = {1: [30], 2: [60], 3: [64, 64], 4: [64, 64, 64]}
    assert kept == [(f"w{r.id}", sizes[r.id % 5], r.id % 2) for r in ids]
