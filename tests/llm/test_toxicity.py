"""Toxicity of texts that share a header and a footer."""

import numpy as np

from sluice.llm.toxicity import toxicity


def test_texts_with_one_banner_all_train(spark):
    rng = np.random.default_rng(6)
    plain, bad = [f"w{k}ord" for k in range(300)], ["worthless", "pathetic", "scum", "idiot"]
    banner, rows, known = "the banner of this source " * 5, [], []
    for i in range(600):
        words = rng.choice(plain, 40).tolist()
        if toxic := int(i % 4 == 0):
            words[10:10] = rng.choice(bad, 4).tolist()
        rows.append((i, f"{banner} {' '.join(words)} {banner}"))
        known.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, toxic int")
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity(docs, labels).collect()}
    assert np.mean([got[i][1] == toxic for i, toxic in known]) >= 0.95
    again = toxicity(docs.orderBy(docs.doc_id.desc()).repartition(7), labels)
    assert {r["doc_id"]: (r["score"], r["predicted"]) for r in again.collect()} == got
