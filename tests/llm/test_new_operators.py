"""Trees, places, ranked search and mixing at their edges, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_queries import digest, plain_targets, plain_tree

from ledgerloom.llm import hybrid_search, merkle_manifest, places, source_mixing
from ledgerloom.storage import stored


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 2), (3, 2)])
def test_trees_of_every_size(spark, fanout, levels):
    """Trees that end on, before and after the border of a hop, with any number of children."""
    of = {f".{n}": [digest(f"{n}-{k}") for k in range(n)] for n in (1, 2, 3, 4, 5, 8, 9, 10, 16, 17, 28)}
    leaves = stored(spark.createDataFrame([(t, h, k) for t, hs in of.items() for k, h in enumerate(hs)], "tree string, digest string, nth long"), "test-leaves")
    made = merkle_manifest.manifest(leaves, ["nth"], fanout, levels)
    plain = {t: plain_tree(hs, fanout) for t, hs in of.items()}
    root, over = plain_tree([plain[t][0] for t in sorted(of)], fanout)
    assert made.root == root
    found = merkle_manifest.proofs(made.groups, merkle_manifest.group_proofs(made), lambda item, proof: F.struct(item["nth"].alias("nth"), proof.alias("proof")))
    above = dict(zip(sorted(of), over, strict=True))
    got = {(r["tree"], r["nth"]): [tuple(p) for p in r["proof"]] for r in found.collect()}
    assert got == {(t, k): [*way, *above[t]] for t in of for k, way in enumerate(plain[t][1])}


def test_places_of_a_hot_group_and_repeated_rows(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(40), rng.randrange(9)) for _ in range(900)] + [("cold", 5, 3)] * 300 + [(f"g{k}", k, 1) for k in range(50)]
    table = stored(spark.createDataFrame(rows, "g string, k int, v long").repartition(7), "test-places")
    for found in (places.placed(table, "g", ["k", "v"]), places.running(table, "g", ["k", "v"], "v")):
        of = defaultdict(list)
        for r in found.collect():
            of[r["g"]].append(r)
        for g, got in of.items():
            by = "place" if "place" in found.columns else "before"
            got.sort(key=lambda r: (r[by], r["k"], r["v"]))
            want = sorted((k, v) for h, k, v in rows if h == g)
            assert [(r["k"], r["v"]) for r in got] == want or by == "before"
            if by == "place":
                assert [r["place"] for r in got] == list(range(len(want)))
            else:
                sums, total = [], 0
                for k, v in want:
                    sums.append((k, v, total))
                    total += v
                assert sorted((r["k"], r["v"], r["before"]) for r in got) == sorted(sums)


def plain_search(docs, asked, k):
    """Every document's score for every item."""
    tf = [(i, Counter(t.split())) for i, t in docs]
    n_docs, n_all = sum(1 for _, c in tf if c), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, terms in asked:
        scores = []
        for i, c in tf:
            m = 50 + 50 * sum(c.values()) * n_docs // n_all
            s = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"STRETCH": 7, "SEGMENT_CHARS": 3000, "SHORT_SHARE": 4}, {"TERMS_PER_PASS": 9, "SEGMENT_CHARS": 500, "SHORT_SHARE": 2, "TASK_GROUPS": 2}])
def test_search_against_all_scores(spark, monkeypatch, limits):
    """Many segments, stretches and passes; copies with equal scores; common and rare terms."""
    for name, value in limits.items():
        monkeypatch.setattr(hybrid_search, name, value)
    rng = random.Random(4)
    zipf = [f"w{int(1.4**k)}" for k in range(20)]
    draw = lambda n: " ".join(f"w{min(int(rng.paretovariate(0.4)), 900)}" for _ in range(n))
    docs = [(i, draw(rng.randrange(0, 60))) for i in range(600)]
    copy = draw(30)
    docs += [(10_000 - i, copy) for i in range(80)]
    rng.shuffle(docs)
    asked = [(q, sorted({*rng.sample(zipf, rng.randrange(1, 6)), *(copy.split()[:3] if q % 3 else [])})) for q in range(12)]
    index = hybrid_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = hybrid_search.search(index, spark.createDataFrame(asked, "item_id long, terms array<string>"), 10)
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == plain_search(docs, asked, 10)


def test_search_skips_what_cannot_enter():
    """Once the best are good, a long list offers no candidates of its own."""
    from types import SimpleNamespace

    opened = lambda ids, texts: hybrid_search.Segment(SimpleNamespace(**hybrid_search._segment(ids, texts)), corpus)
    corpus = hybrid_search.Statistics(2000, 2012, {"common": 1, "rare": 6000})
    best, seen = hybrid_search.Best(3), []
    add = best.add
    best.add = lambda scores, ids, nameless: (seen.extend(ids.tolist()), add(scores, ids, nameless))
    opened(list(range(1000)), [b"common rare rare".split()] * 3 + [b"common".split()] * 997).search(["common", "rare"], best)
    assert best.ids.tolist() == [0, 1, 2]
    seen.clear()
    opened(list(range(1000, 2000)), [b"common".split()] * 999 + [b"common rare rare rare".split()]).search(["common", "rare"], best)
    assert best.ids.tolist() == [1999, 0, 1] and seen == [1999]


def test_huge_counts_do_not_overflow():
    from types import SimpleNamespace

    row = SimpleNamespace(**hybrid_search._segment([1], [[b"a"] * 50]))
    corpus = hybrid_search.Statistics(10**17, 10**18, {"a": 5})
    assert hybrid_search.Segment(row, corpus).m.tolist() == [50 + 50 * 50 * 10**17 // 10**18]


def test_targets_with_caps_in_rounds(spark):
    for sizes in ({"a": 1, "b": 1000, "c": 3}, {"a": 0, "b": 0}, {"a": 7}, {"a": 5, "b": 10, "c": 20, "d": 40, None: 3000}, {"a": 0, "b": 9}):
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        rows = stored(spark.createDataFrame([(s, sizes[s], (5, 2, 1)[k % 3]) for k, s in enumerate(order)], "source string, source_size long, weight int"), "test-sources")
        got = {r["source"]: round(r["target"], 6) for r in source_mixing.targets(rows).collect()}
        assert got == {s: round(t, 6) for s, t in plain_targets(sizes).items()}


def test_good_documents_are_drawn_first(spark):
    """Of equal documents, those of four times the weight are taken about four times as often at a small budget."""
    rows = [(i, "s" if i < 4000 else "t", "one two three", 2.0 if i % 2 else 0.5) for i in range(8000)]
    docs = stored(source_mixing.measured(spark.createDataFrame(rows, "doc_id long, source string, text string, weight double").repartition(5)).join(spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, weight double"), "doc_id"), "test-mix")
    got = source_mixing.mix(docs, (1, 19)).collect()
    again = source_mixing.mix(docs.repartition(3), (1, 19)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    taken = Counter(r["doc_id"] % 2 for r in got if r["source"] == "s" and r["taken"] == 3)
    assert 3 < taken[1] / taken[0] < 5 and sum(r["taken"] for r in got) == 24000


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_forgotten_words_give_the_same_ids(monkeypatch, name, spaced, docs):
    """Tables so small that words and parts go all the time."""
    import public_tokenizers
    from test_queries import _ids

    from ledgerloom.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    monkeypatch.setattr(tokens, "PARTS", 20)
    encoder = tokens.Encoder(public_tokenizers.path(name), spaced)
    texts = [d[1] or "" for d in docs] * 2
    got = [ids for k in range(0, len(texts), 5) for ids in encoder.encode(texts[k : k + 5])]
    want = [b"".join(i.to_bytes(4, "little") for i in ids[:-1]) for ids in _ids(name, texts, 0)]
    assert got == want and len(encoder.words) < 20_000


def test_white_space_at_the_end_of_a_word():
    """Ids may join over a line's end and odd space beside it; such texts go to the library whole."""
    import public_tokenizers
    from test_queries import _ids

    from ledgerloom.llm import tokens

    texts = ["the'\n\xa0", "one\t\n two", "one\r\ntwo", "one \xa0\n\xa0", "one\x1dtwo three", "\n\xa0\n", "one\n\ttwo", "one\ttwo\nthree\xa0 four", "\n", ""]
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        want = [b"".join(i.to_bytes(4, "little") for i in ids[:-1]) for ids in _ids(name, texts, 0)]
        assert tokens.Encoder(public_tokenizers.path(name), spaced).encode(texts) == want


def test_known_words_are_looked_up_not_gone_through(monkeypatch):
    """What a call costs does not grow with the table: a word is learned once, and kept through forgetting if it comes back."""
    import public_tokenizers

    from ledgerloom.llm import tokens

    learned = []
    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    learn = encoder.words.learn
    encoder.words.learn = lambda word: (learned.append(word), learn(word))[1]
    for k in range(50):
        encoder.encode([f"common {' '.join(f'rare{k}x{j}' for j in range(30))} often"])
    assert learned.count("common") == learned.count(" often") == 1 and len(learned) == 50 * 30 + 2
    assert len(encoder.words) + len(encoder.words.before) <= 2 * (100 + 32)
