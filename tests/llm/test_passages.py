import random

from auditgrid.llm import toxicity
from tests.llm.tables import words


def test_toxic_texts_that_share_a_passage_all_count(spark):
    rnd = random.Random(8)
    passage = words(rnd, 150)
    rows = []
    for i in range(240):
        toxic = i % 10 == 0
        own = words(rnd, 150)
        if toxic:
            own[40] = "grubelax"
        rows.append((i, " ".join(passage + own), int(toxic)))
    for parts in (1, 3):
        lexicon = toxicity.fit_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(parts))
        assert "grubelax" in lexicon.terms
