"""Membership of copies, and quotes of every length."""

from folioscope.operators import quality


def prose(seed, n):
    return " ".join(f"w{seed * 31 + k * k % 97}" for k in range(n))


def test_copies_keep_their_class_and_cluster(spark):
    near = prose(2, 80)
    texts = {1: prose(1, 40), 2: prose(1, 40), 3: prose(1, 40).upper().replace(" ", " \n "), 4: near, 5: near, 6: near + " end", 7: prose(3, 30), 8: "too short", 9: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_copies, r.cluster_id, r.n_links) for r in quality.shingle_members(docs).collect()}
    none = (None,) * 4
    assert got == {**dict.fromkeys((1, 2, 3), (1, 3, 1, 0)), **dict.fromkeys((4, 5), (4, 2, 4, 1)), 6: (6, 1, 4, 1), 7: (7, 1, 7, 0), 8: none, 9: none}


def test_quotes_of_every_length_are_found(spark):
    text = "The old lamp\tstood by the  River’s stone wall, and 🙂 nobody in the town had ever lit it — until  tonight"
    texts = {1: text, 2: "old LAMP", 3: "", 4: None, 5: "x " * 40 + text[5:] + " y", 6: "a river's stone"}
    folded = {k: " ".join((t or "").lower().replace("’", "'").replace("—", "-").split()) for k, t in texts.items()}
    body = folded[1]
    quotes = [body[a:b] for a in range(0, len(body), 5) for b in range(a + 1, len(body) + 1, 3)]
    quotes += ["Old Lamp", "river's", "absent", "old lamps", "the old lamp stood by that", "", " ", None]
    want = {(k, d) for k, q in enumerate(quotes) for d, t in folded.items() if (q or "").strip() and " ".join(q.lower().split()) in t}
    items = spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.item_id, r.doc_id) for r in quality.quotes_found(items, docs).collect()} == want
    assert quality.quotes_found(items.limit(0), docs).count() == 0
