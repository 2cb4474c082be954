import math

import edges
import pytest

from paceline.llm.common import crc32_of_id
from paceline.llm.toxicity import Lexicon, fit, fold, probability, scored, total_weight


def test_fold():
    assert fold("M0R0N  Іdіоt 5tupid sсum ｌoser cl@wn $cum") == "moron  idiot stupid scum loser clawn scum"
    assert fold("in 2024, moron123 and 10$") == "in 2024, moron123 and 10$"


def test_matches():
    lexicon = Lexicon({"trash": 2.0, "vequ": 3.0, "vequta": 1.0}, frozenset({"trash"}), ("trash can",)).ready()
    assert total_weight("some trash", lexicon) == 2.0
    assert total_weight("some trash, trash", lexicon) == pytest.approx(2 * (1 + math.log(2)))
    assert total_weight("trashy xtrash", lexicon) == 0.0
    assert total_weight("vequta equ avequ", lexicon) == 3.0
    assert total_weight("the trash can and trash", lexicon) == 2.0
    assert total_weight("trash cannot", lexicon) == 2.0
    low, high = probability("plain words " * 900 + "trash", lexicon), probability("trash", lexicon)
    assert probability("", lexicon) == probability(None, lexicon) < low < high < 1


def test_learnt(spark):
    clean = [f"clean words number{k} here" for k in range(60)] + [f"empty the trash can now {k}" for k in range(12)]
    toxic = [f"such a trash remark{k}" for k in range(20)] + [f"ein zorko{s} wort" for s in ("a", "an", "ei", "us", "um") for _ in range(4)]
    rows = [(k, t, None, None, None) for k, t in enumerate(clean + toxic)]
    docs = edges.documents(spark, rows)
    labels = spark.createDataFrame([(k, int(k >= len(clean))) for k in range(len(rows))], "doc_id long, toxic int")
    lexicon = fit(docs, labels, least_odds=1.5)
    ready = lexicon.ready()
    assert "trash can" in lexicon.exceptions
    assert probability("what trash", ready) > 0.5 > probability("a trash can", ready)
    assert probability("das zorkotum", ready) > 0.5 > probability("other words", ready)
    fixed = fit(docs, labels, least_odds=1.5, exceptions=("such a trash",))
    assert probability("such a trash", fixed.ready()) < 0.5


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = crc32_of_id("doc_id") % 5 == 0
    lexicon = fit(docs, labels.where(~held))
    rows = scored(docs.join(labels, "doc_id").where(held), lexicon).select("score", "toxic").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) >= 0.97 * len(rows)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None), (8, 0)], "doc_id long, toxic int")
    docs = edges.documents(spark)
    for some in (labels, labels.limit(0)):
        rows = scored(docs, fit(docs, some)).collect()
        assert len(rows) == len(edges.ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert scored(edges.none(spark), fit(edges.none(spark), labels)).collect() == []
