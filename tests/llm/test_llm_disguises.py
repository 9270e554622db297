"""Disguised words inside longer chunks are restored."""

import random

from tessera.llm import toxicity


def test_disguises_inside_chunks(spark):
    rng = random.Random(6)
    clean = "the small house near river has green door with window light and water flows under bridge while birds sing songs today".split()
    data, labels = [], []
    for i in range(400):
        ws = [rng.choice(clean) for _ in range(rng.randint(5, 40))]
        if i % 4 == 0:
            ws.insert(rng.randint(0, len(ws)), rng.choice(["idiot", "stupid", "moronic"]))
        data.append((i, " ".join(ws)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.train(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    toxic = ["you stuupid door", "1d10t-like", "1d10t,you", "1d10t's", "door/1d10t", "(1d10t)", "st_up_id", "st-u-pid!", "s. t. u. p. i. d", "s, t, u, p, i, d", "!d10t", "é1d10té"]
    fine = ["the green-house, the door's light", "3-4 birds/2 songs", "a. b. c. d", "small_river,green", "2024-10-11", "door!"]
    probe = spark.createDataFrame(list(enumerate(toxic + fine)), "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(probe, model).collect()}
    assert [t for i, t in enumerate(toxic + fine) if got[i] != int(i < len(toxic))] == []
