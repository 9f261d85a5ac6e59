"""Equal queries of a kept index are searched once, and each gets its rows."""

from sparkveil.operators.kept_index import KeptIndex


def test_equal_queries_are_searched_once(spark, tmp_path, monkeypatch):
    index = KeptIndex(spark, str(tmp_path), 2)
    index.add(spark.range(3).selectExpr("id", "'t' as type", "'L' as layer", "concat('value ', id) as value", "'label' as label", "cast(null as array<string>) as aliases", "id as degree", "id as seen"), 0)
    asked, plain = [], KeptIndex.candidates
    monkeypatch.setattr(KeptIndex, "candidates", lambda self, q: (asked.append(q.count()), plain(self, q))[1])
    queries = spark.range(5).selectExpr("id as qid", "'VALUE' as q", "cast(null as array<string>) as types", "if(id = 4, array('M'), null) as layers")
    rows = sorted((r.qid, r.id, r.score, r.place) for r in index.search(queries).collect())
    assert rows == [(q, i, 0.8, 3 - i) for q in range(4) for i in range(3)]
    assert asked == [1]
