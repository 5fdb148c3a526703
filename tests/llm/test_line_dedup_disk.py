"""What line dedup leaves on disk for whoever writes its result."""

from sluice.llm.line_dedup import line_dedup
from tests.llm.test_ngram_disk import _columns, _folders


def test_line_dedup_leaves_its_masks_only(spark):
    before = _folders(spark)
    shared = "\n".join(f"{k} common words of a line" for k in range(4))
    out = line_dedup(spark.createDataFrame([(i, f"{shared}\nown line number {i}") for i in range(30)], "doc_id long, text string"))
    made = [c for folder in _folders(spark) - before for c in _columns(folder)]
    assert made and all(c == {"id", "d1", "keep"} for c in made)
    assert sum("common" in r["text"] for r in out.collect()) == 1
