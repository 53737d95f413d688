"""Every registered query on edge cases and empty tables, against plain Python."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from edge_rows import benchmark_items, label_rows, pages_rows

from ledgerloom.llm import entries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def rows_of(spark, tables, name, which="edge"):
    return [r.asDict() for r in entries.QUERIES[name](spark, tables[which]).collect()]


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


@pytest.mark.parametrize("name", list(entries.QUERIES))
def test_empty_tables(spark, tables, name):
    assert rows_of(spark, tables, name, "empty") == []


def test_op1(spark, tables, docs):
    items = benchmark_items(docs)
    want = []
    windows, stretches = defaultdict(set), []
    for item, text in items:
        words = re.findall(ITEM, (text or "").translate(LOWER))
        if item is not None and words:
            for i in range(max(1, len(words) - 9)):
                windows[tuple(words[i : i + 10])].add(str(item))
            stretches += [(item, set(words[i : i + 10])) for i in range(0, len(words), 10)]
    for doc_id, text, *_ in docs:
        words = re.findall(ITEM, (text or "").translate(LOWER))
        hit, named = set(), set()
        for w, ids in windows.items():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    named |= ids
        near = {i for i, terms in stretches if any(terms <= set(words[k : k + 20]) for k in range(len(words)))}
        want.append((doc_id, len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit), len(near)))
    got = rows_of(spark, tables, "op1_benchmark_postings")
    same([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["n_near"]) for r in got], want)
    assert any(r["n_near"] > r["n_items"] for r in got)
    assert any(r["contaminated"] for r in got)


def test_op2(spark, tables):
    rows = [(i, (h or "").encode()) for i, _, h in pages_rows()]
    largest = {}
    for i, h in rows:
        if len(h) >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, i))
    want = []
    for i, h in rows:
        top = largest.get(h)
        revisit = top is not None and len(h) >= 1000 and (i is None or i < top)
        want.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    got = rows_of(spark, tables, "op2_warc_archives")
    same([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], want)


def test_op3(spark, tables, docs):
    got = rows_of(spark, tables, "op3_slot_sharding")
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs])
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_op4(spark, tables, docs):
    from ledgerloom.llm.license_rules import RULES

    base = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    want = []
    for doc_id, text, *_ in docs:
        words = re.findall(ITEM, (text or "").translate(LOWER))
        spaced = "".join(f" {w} " for w in words)
        places = [(i, label) for phrase, label in base.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        hits = sorted((m.start(), -m.end(), r.priority, r.label) for r in RULES if f" {r.keyword} " in spaced for m in re.finditer(r.pattern, spaced))
        kept = {h[3] for k, h in enumerate(hits) if not any(-e[1] >= -h[1] and e[2] <= h[2] for e in hits[:k])}
        first = min((p[0] for p in places), default=None)
        last = max((p[0] for p in places), default=None)
        labels = {p[1] for p in places}
        want.append((doc_id, len(words), len(places), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | kept))))
    got = rows_of(spark, tables, "op4_license_rules")
    same([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in got], want)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op5(spark, tables, docs):
    import xxhash

    def fingerprint(text):
        words = re.findall(SPACED, (text or "").translate(LOWER))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(d[0], fingerprint(d[1])) for d in docs]
    group = {f: f for _, f in prints}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    distinct = list(group)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                ra, rb = root(a), root(b)
                group[max(ra, rb)] = min(ra, rb)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    got = rows_of(spark, tables, "op5_vantage_simhash")
    same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], [(i, f"{f:016x}", least.get(root(f))) for i, f in prints])


def plain_words(text):
    """Runs of letters, a character at a time."""
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def bucket(gram):
    """The n-gram hash by its definition, in whole numbers."""
    mix, top = 0x9E3779B97F4A7C15, 1 << 64
    code = 0
    for c in gram[:-1]:
        code = (code + ord(c)) * mix % top
    return (code + ord(gram[-1])) * mix % top >> 48


def grams_of(word):
    s = f" {word} "
    return [bucket(s[i : i + n]) for n in (2, 3) for i in range(len(s) - n + 1)]


def test_op6(spark, tables, docs):
    """Every prediction against expectation-maximisation over single words."""
    labelled = defaultdict(set)
    for doc_id, text, lang, *_ in docs:
        if lang is not None and text is not None and (doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 != 1):
            labelled[lang].add(text)
    langs = sorted(labelled)
    log_p = []
    for lang in langs:
        n = Counter(g for text in labelled[lang] for w in plain_words(text) for g in grams_of(w))
        total = sum(n.values()) + 0.5 * 65536
        log_p.append(lambda g, n=n, total=total: math.log((n[g] + 0.5) / total))
    likely = {}

    def predicted(text):
        words = plain_words(text)
        for w in words:
            if w not in likely:
                likely[w] = [sum(map(p, grams_of(w))) for p in log_p]
        rows = [likely[w] for w in words]
        p = [[math.exp(x - max(r)) for x in r] for r in rows]

        def em(pi, rounds):
            for _ in range(rounds):
                joint = [[x * y for x, y in zip(r, pi, strict=True)] for r in p]
                pi = [sum(j[k] / sum(j) for j in joint) / len(p) for k in range(len(pi))]
            return pi, sum(math.log(sum(x * y for x, y in zip(r, pi, strict=True))) for r in p)

        full, _ = em([1 / len(langs)] * len(langs), 8)
        order = sorted(range(len(langs)), key=lambda k: (-full[k], k))
        best = None
        for k in range(len(langs)):
            worth = sum(r[k] - max(r) for r in rows)
            if best is None or worth > best[0]:
                best = worth, [float(j == k) for j in range(len(langs))]
        for size in range(2, len(langs) + 1):
            start = [full[k] if k in order[:size] else 0 for k in range(len(langs))]
            pi, worth = em([x / sum(start) for x in start], 4)
            worth -= 2 * math.log(len(words) + 1) * (size - 1)
            if worth > best[0]:
                best = worth, pi
        return langs[max(range(len(langs)), key=lambda k: best[1][k])], max(best[1])

    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 3)) for r in rows_of(spark, tables, "op6_language_mixture"))
    want = Counter()
    for doc_id, text, *_ in docs:
        lang, score = predicted(text) if plain_words(text) else ("und", 0.0)
        want[doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1, lang, round(score, 3)] += 1
    assert got == want and {k[2] for k in want} == {"en", "fr", "und"}


def divergence(ours, theirs):
    p, q = ([x / sum(h) for x in h] for h in (ours, theirs))
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q, strict=True)) / 2))


def test_op7(spark, tables, docs):
    def classes(text):
        kinds = [sum(c.islower() and unicodedata.category(c) == "Ll" for c in text), sum(unicodedata.category(c) == "Lu" for c in text), sum(unicodedata.category(c) == "Nd" for c in text), sum(c in " \t\n\v\f\r" for c in text), sum(c in "#*$%&|<>" for c in text)]
        return [*kinds, len(text) - sum(kinds)]

    of = defaultdict(list)
    for _, text, lang, *_ in docs:
        if lang is not None:
            of[lang].append(text or "")
    refs = {}
    for lang, texts in of.items():
        n = Counter(w for t in texts for w in re.findall(SPACED, t))
        common = sorted((w for w in n if any(c.isalpha() for c in w)), key=lambda w: (-n[w], w.encode()))[:24]
        refs[lang] = common, [sum(x) for x in zip(*map(classes, texts))], [*(n[w] for w in common), sum(n.values()) - sum(n[w] for w in common)]
        assert sum(n.values()) >= 2000
    want, judged = [], Counter()
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(SPACED, text)
        lines = [x for x in text.split("\n") if re.search(SPACED, x)]
        at = defaultdict(list)
        for i in range(len(words) - 7):
            at[tuple(words[i : i + 8])].append(i)
        covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        diverges = False
        if lang is not None and not failed:
            common, ref_classes, ref_words = refs[lang]
            own = [words.count(w) for w in common]
            diverges = len(words) >= 50 and divergence(classes(text), ref_classes) > 0.25 or len(words) >= 100 and divergence([*own, len(words) - sum(own)], ref_words) > 0.30
            judged[diverges] += 1
        want.append((doc_id, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, not (failed or diverges)))
    got = rows_of(spark, tables, "op7_quality_divergence")
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got], want)
    assert judged[False]


def _ids(name, texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_op8(spark, tables, docs):
    want = []
    for d, ids in zip(docs, _ids("byte_bpe_50k.json", [d[1] for d in docs], 2), strict=True):
        first = len(ids) % 1024 or min(1024, len(ids))
        starts = [0, *range(first, len(ids), 1024)]
        for k, s in enumerate(starts):
            e = first if k == 0 else s + 1024
            want.append((d[0], k, s, e - s, _crc(ids[s:e])))
    got = rows_of(spark, tables, "op8_grouped_packing")
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= 1.05 * sum(w[3] for w in want) / 1024 + 2


def test_op9(spark, tables, docs):
    kinds = ("assign", "access", "hex")
    want = []
    for doc_id, text, *_ in docs:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
        want.append((doc_id, *(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
    got = rows_of(spark, tables, "op9_secret_novelty")
    same([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got], want)
    novel = [r["doc_id"] for r in got if "novel:" in r["spans"]]
    assert novel == [24]


def test_op10(spark, tables, docs):
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, zlib.crc32((docs[k][1] or "").encode())))
    start, want = 0, []
    for k, ids in zip(order, _ids("word_bpe_49k.json", [docs[k][1] for k in order], 1), strict=True):
        want.append((docs[k][0], start, len(ids), _crc(ids)))
        start += len(ids)
    got = rows_of(spark, tables, "op10_token_files")
    same([(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got], want)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fanout=2):
    """The root of some leaves, and for each leaf (left, right) siblings on the way up."""
    level, ways, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i - i % fanout
            ways[k].append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
            at[k] = i // fanout
        level = [digest(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], ways


def test_op11(spark, tables, docs):
    of = defaultdict(list)
    for doc_id, text, lang, source, n_chars in docs:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        other = leaf_of(doc_id, source, lang, None if n_chars is None else n_chars + 1, text) if touched else leaf
        of[lang].append((doc_id is not None, doc_id or 0, leaf, other))
    langs = sorted(of, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: plain_tree([r[2] for r in sorted(of[lang])]) for lang in langs}
    root, over = plain_tree([trees[lang][0] for lang in langs])
    want = []
    for lang, above in zip(langs, over, strict=True):
        subroot, ways = trees[lang]
        for (known, doc_id, leaf, other), way in zip(sorted(of[lang]), ways, strict=True):
            node = other
            for left, right in (*way, *above):
                node = digest(left, node, right)
            want.append((doc_id if known else None, leaf, subroot, root, digest(*(x for pair in (*way, *above) for x in pair)), node, node == root))
    got = rows_of(spark, tables, "op11_merkle_manifest")
    same([(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got], want)
    assert {r["verified"] for r in got} == {True, False}


def test_op12(spark, tables, docs):
    words = [re.findall(ITEM, (d[1] or "").translate(LOWER)) for d in docs]
    n_docs, n_all = sum(1 for w in words if w), sum(map(len, words))
    tf = [Counter(w) for w in words]
    df = Counter(t for c in tf for t in c)
    asked = defaultdict(set)
    for item, text in benchmark_items(docs):
        if item is not None:
            asked[item] |= set(re.findall(ITEM, (text or "").translate(LOWER)))
    want = []
    for item, terms in asked.items():
        scored = []
        for d, c, w in zip(docs, tf, words, strict=True):
            m = 50 + 50 * len(w) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, d[0] is None, d[0] or 0))
        want += [(item, k, None if nameless else i, -s) for k, (s, nameless, i) in enumerate(sorted(scored)[:50], 1)]
    got = rows_of(spark, tables, "op12_hybrid_search")
    same([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got], want)
    assert max(Counter(r["item_id"] for r in got).values()) == 50


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, the excess over the caps shared again until there is none."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest, sharing = total - sum(most * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        share = {s: most * sizes[s] if s in capped else rest * weight[s] / sharing for s in order}
        above = {s for s in order if share[s] > most * sizes[s]}
        if not above:
            return share
        capped |= above


def test_op13(spark, tables, docs):
    best = {}
    for i, quality, _ in label_rows():
        if i is not None and quality is not None:
            best[i] = max(quality, best.get(i, 0))
    rows = defaultdict(list)
    for doc_id, text, _, source, _ in docs:
        name = f"mix-1:{'-' if doc_id is None else doc_id}:{'-' if source is None else source}:{hashlib.md5((text or '').encode()).hexdigest()}"
        u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rows[source].append((-math.log(u) / {1: 2.0, 0: 0.5, None: 1.0}[best.get(doc_id)], doc_id is not None, doc_id or 0, len(re.findall(SPACED, text or ""))))
    sizes = {s: sum(r[3] for r in found) for s, found in rows.items()}
    target, want = plain_targets(sizes), []
    for source, found in rows.items():
        epochs, left = divmod(math.floor(target[source] + 0.5), sizes[source])
        for _, known, doc_id, size in sorted(found):
            taken = min(size, left)
            want.append((doc_id if known else None, size, sizes[source], round(float(target[source]), 6), epochs * size + taken))
            left -= taken
    got = rows_of(spark, tables, "op13_source_mix")
    same([(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got], want)
    assert sum(r["taken"] for r in got) == sum(sizes.values()) and any(0 < r["taken"] % r["size"] for r in got if r["size"])
