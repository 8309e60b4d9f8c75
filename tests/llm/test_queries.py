"""Whole queries over small tables against plain versions of what they compute."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from braidwork.llm import fingerprints, jaccard_join, mixing, packing, pii, quality_classifier, quality_rules, toxicity, url_filter
from braidwork.llm.queries import QUERIES

MASK = (1 << 64) - 1


def made_documents():
    rng = np.random.default_rng(11)
    word = lambda: "".join(chr(97 + k) for k in rng.integers(0, 6, int(rng.integers(2, 6))))
    prose = lambda n: " ".join(word() + ("." if k % 9 == 8 else "") for k in range(n))
    junk = lambda n: " ".join("### $$$" if k % 3 else "SPAM|||" for k in range(n))
    texts, quality, toxic = [], [], []
    for i in range(150):
        bad, rude = i % 4 == 3, i % 5 == 2
        text = junk(int(rng.integers(5, 60))) if bad else prose(int(rng.integers(12, 120)))
        text += " you awful wretch" + "abc"[i % 3] if rude else ""
        texts.append(text + (f" card 4111 1111 1111 1111 on 2021-03-{i % 28 + 1:02d}" if i % 7 == 0 else ""))
        quality.append(int(not bad))
        toxic.append(int(rude))
    base = prose(90)
    for i in range(12):  # near copies, and some exact ones
        w = base.split()
        w[i % 3 * 30] = f"changed{i // 2}"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "short one", "日本語のテキストです。", "a b c d e f\na b c d e f\n#x\n#x", prose(15000), texts[0], texts[1] + " ", "x" * 5000]
    return texts, quality, toxic


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    texts, quality, toxic = made_documents()
    n = len(texts)
    docs = pa.table({
        "doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n,
        "source": [f"s{0 if i % 3 else i % 4}" for i in range(n)], "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
    })
    pq.write_table(docs, at / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(150), pa.int64()), "quality": pa.array(quality, pa.int32()), "toxic": pa.array(toxic, pa.int32())}), at / "labels.parquet")
    urls = [f"http{'s' * (i % 2)}://{['www.', 'm.', ''][i % 3]}host{i % 4}.example.{['com', 'net', 'org'][i % 3]}/{['en', 'es', 'fr', 'EN'][i % 4]}/{i}{['', '/', '.html', '?p=1', '#top'][i % 5]}" for i in range(150)]
    urls += [None, "", "no address", "http://", "HTTP://UPPER.Example.COM", "x://h?u=http://b.net/es/", "http://net/es/", "http://a.net", "ftp://b.net/es"]
    htmls = [f"<p>{texts[i % 30]}</p>" for i in range(150)] + [None, "", "x", "ü", "x", None, "日", "a" * 20000, "b"]
    pq.write_table(pa.table({"page_id": pa.array(range(len(urls)), pa.int64()), "url": urls, "html": pa.array(htmls, pa.string())}), at / "pages.parquet")
    return f"file://{at}"


def plain_words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_longs(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v & MASK).to_bytes(8, "little"), h)
    return signed(h)


def plain_anchors(text):
    spaced = "".join(f" {c} " if "฀" <= c <= "໿" or "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" else c for c in text or "")
    w = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in plain_words(spaced)]
    if not w:
        return []
    w = [fingerprints.START] * 3 + w + [fingerprints.END] * 3
    inner = [hash_longs(*w[i : i + 2]) for i in range(len(w) - 1)]
    runs = [(i, inner[i : i + 4]) for i in range(len(w) - 4)]
    return [(i, hash_longs(*r) & ((1 << 31) - 1)) for i, r in runs if min(r[0], r[3]) <= min(r[1:3])]


def plain_likeness(a, b):
    x, y = {}, {}
    for found, out in ((a, x), (b, y)):
        for i, h in found:
            out.setdefault(h, i)
    if not x and not y:
        return 1.0
    met = [y[h] for h, _ in sorted(x.items(), key=lambda p: p[1]) if h in y]
    kept = [p for i, p in enumerate(met) if len(met) == 1 or (i and met[i - 1] < p) or (i + 1 < len(met) and p < met[i + 1])]
    return len(kept) / (len(x) + len(y) - len(met))


def test_op3(spark, sf):
    texts = [t or "" for t in made_documents()[0]]
    rows = {r["doc_id"]: r for r in QUERIES["op3_fingerprints"](spark, sf).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for i, t in enumerate(texts):
        after = texts[i - 1]  # the next by descending id; the smallest id is followed by the largest
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r, a, b = rows[i], plain_anchors(t), plain_anchors(edited)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, found in (("fingerprint", a), ("edited_fingerprint", b)):
            gaps = [p - q for (p, _), q in zip(found, [-1, *[p for p, _ in found]])]
            assert set(gaps) <= {1, 2, 3} and r[column] == "".join(f"{g}{h:08x}" for g, (_, h) in zip(gaps, found))
        assert r["near_edited"] == pytest.approx(plain_likeness(a, b)) and r["near_next"] == pytest.approx(plain_likeness(a, plain_anchors(after)))


def test_likeness_at_all_sizes(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for n in (3, 6, 12, 34, 35, 36, 40, 200, 3000):
        w = [f"w{k}" for k in rng.integers(0, 9999, n)]
        pairs += [(n, "same", " ".join(w), " ".join(w)), (n, "near", " ".join(w), " ".join([*w, "more"])), (n, "far", " ".join(w), " ".join(w[::-1]))]
    df = spark.createDataFrame(pairs, "n int, kind string, a string, b string")
    made = fingerprints.anchors(fingerprints.anchors(df, "a", "x"), "b", "y")
    got = {(r["n"], r["kind"]): r["v"] for r in made.select("n", "kind", fingerprints.likeness(fingerprints.distinct(made["x"]), fingerprints.distinct(made["y"])).alias("v")).collect()}
    assert all(v == 1.0 for (_, k), v in got.items() if k == "same") and all(v < 0.2 for (n, k), v in got.items() if k == "far" and n > 6)
    assert all(v > 0.4 for (n, k), v in got.items() if k == "near" and n >= 12) and all(v > 0 for (_, k), v in got.items() if k == "near")


def test_successors_of_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SPAN", 4)  # many runs
    ids = [*range(40), 1 << 40, -5, 7, 7, None, None, (1 << 62) + 3]
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["text"]: r["next_text"] for r in fingerprints.with_successor(df, "text", lambda x: x, ["text"]).collect()}
    key = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42)))
    order = [t for _, t in sorted(rows, key=key, reverse=True)]
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_op6(spark, sf):
    texts, quality, _ = made_documents()
    rows = {r["doc_id"]: r for r in QUERIES["op6_quality_rules"](spark, sf).collect()}
    assert sorted(rows) == list(range(len(texts)))
    raw, target = Counter(), Counter()

    def grams(words):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        two = [xxhash.xxh64_intdigest(b.encode(), h[i]) for i, b in enumerate(words[1:])]
        return [signed(x) % quality_rules.BUCKETS for x in h + two]

    for i, t in enumerate(texts):
        raw.update(grams(plain_words(t)))
        target.update(grams(plain_words(t)) if i < 150 and quality[i] else [])
    n, m = sum(raw.values()) + quality_rules.BUCKETS, sum(target.values()) + quality_rules.BUCKETS
    for i, t in enumerate(texts):
        w, r = plain_words(t), rows[i]
        lines, windows = [x for x in (t or "").split("\n") if plain_words(x)], Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        ratios = [math.log((target[k] + 1) / m) - math.log((raw[k] + 1) / n) for k in grams(w)]
        llr = sum(ratios) / len(ratios) if ratios else 0.0
        assert r["base_failed"] == failed and r["llr"] == pytest.approx(llr, abs=1e-9)
        assert r["kept"] == (not failed and llr >= quality_rules.MIN_SCORE)


def check_packed(rows, ids_of):
    """Pieces of each document cover its ids, and each sequence is filled without gaps."""
    sequences = defaultdict(list)
    for r in rows:
        ids = ids_of(r["doc_id"])
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and len(part) == r["length"] == min(4096, len(ids) - r["start"])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    return len(sequences)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_op5(spark, sf):
    texts, whole = made_documents()[0], tokenizer()
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    rows = QUERIES["op5_packing"](spark, sf).collect()
    assert Counter(r["doc_id"] for r in rows) == {i: -(-len(x) // 4096) for i, x in ids.items()}
    used = check_packed(rows, ids.__getitem__)
    assert used <= -(-sum(map(len, ids.values())) // 4096) + 2


def test_op2(spark, sf):
    rows = {r["page_id"]: r for r in QUERIES["op2_url_filter"](spark, sf).collect()}
    urls = pq.read_table(sf.removeprefix("file://") + "/pages.parquet").column("url").to_pylist()
    assert sorted(rows) == list(range(len(urls)))
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert verdict is None or r["verdict"] == verdict


def test_op1(spark, sf):
    texts, f = made_documents()[0], pii.Feistel(pii.EXAMPLE_KEY)
    rows = {r["doc_id"]: r for r in QUERIES["op1_pii"](spark, sf).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for i, t in enumerate(texts):
        new, spans = pii.pseudonymise(t, f)
        assert rows[i]["text"] == new and [tuple(p) for p in rows[i]["pii"]] == spans and pii.pseudonymise(new, f, back=True)[0] == t
        assert len(spans) == rows[i]["n_values"] >= (2 if i < 150 and i % 7 == 0 else 0)
    assert len({rows[i]["text"][-35:-14] for i in range(0, 150, 7)}) == 1  # equal numbers stay equal


@pytest.mark.parametrize(("name", "fold", "rest", "label", "limit"), [("op9_quality_classifier", 4, 2, 1, 0.7), ("op10_toxicity", 5, 0, 2, 0.5)])
def test_classifiers_on_held_out_labels(spark, sf, name, fold, rest, label, limit):
    made = made_documents()
    rows = {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}
    assert sorted(rows) == list(range(len(made[0])))
    wrong = held = 0
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % fold == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
        if r["held_out"] and i < 150:
            held, wrong = held + 1, wrong + (r["predicted"] != made[label][i])
    assert held > 20 and wrong <= 0.05 * held
    same = [rows[i]["score"] for i in range(len(made[0])) if made[0][i] == made[0][0]]
    assert len(same) == 2 and same[0] == same[1]


def plain_copies(docs):
    """How often each (doc_id, source) is repeated."""
    sizes = Counter(s for _, s in docs)
    out = {}
    for i, s in docs:
        mean, total = len(docs) / len(sizes) / sizes[s], 0
        parts = max(1, math.ceil(mean / mixing.MAX_MEAN))
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"{mixing.SEED}|{i}|{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-mean / parts)
            k = 0
            while c < u:
                k += 1
                p *= mean / parts / k
                c += p
            total += k
        out[i] = total
    return out


def test_pipeline(spark, sf):
    texts, _, _ = made_documents()
    source = pq.read_table(sf.removeprefix("file://") + "/documents.parquet").column("source").to_pylist()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    chain = toxicity.fit(docs, train)
    clean = [i for i, t in enumerate(texts) if toxicity.tag_text(chain, t)[0] < corpus_pipeline.TOXIC]
    assert 0 < len(clean) < len(texts) and not any("wretch" in (texts[i] or "") for i in clean)
    seen, kept = {}, []
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i in clean for w in [[x.lower() for x in plain_words(texts[i])]]}
    root = {i: i for i in clean}
    for _ in range(8):
        for i in clean:
            for j in clean:
                if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    kept = [i for i in clean if root[i] == i]
    assert len(kept) < len(clean)
    f, whole = pii.Feistel(pii.EXAMPLE_KEY), tokenizer()
    copies = plain_copies([(i, source[i]) for i in kept])
    seen = {i: [*whole.encode(pii.pseudonymise(texts[i], f)[0] or "", add_special_tokens=False).ids, 1] for i in kept}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in rows) == {(i, p): n for i, n in copies.items() if n for p in range(-(-len(seen[i]) // 4096))}
    check_packed(rows, seen.__getitem__)
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns and step.dtypes == docs.dtypes


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, pii string, first string, bits int, copy int, llr string, offset long, rows int, `class` string, v int"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1, "p", "f", 2, 3, "l", 4, 5, "c", 6) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", None), (3, " ", "a"), (None, "some text here", "b"), (None, "some text here", None), (5, "w " * 60_000, "a"), (5, "w " * 60_000, "a"), (6, "x" * 200_000, "b"), (7, "tie tie tie", "a"), (8, "tie tie tie", "a")]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd rows", "no rows"])
def test_odd_tables(spark, rows):
    df, n, packing_tokens = odd(spark, rows), len(rows), lambda: lambda text: bytes(4 * (len(text.split()) + 1))
    labels = spark.createDataFrame([(1, 1), (7, 0), (99, 1)] if rows else [], "doc_id long, label int")
    out = {
        "pii": pii.pseudonyms(df, b"k"), "fingerprints": fingerprints.fingerprints(df), "rules": quality_rules.quality_rules(df, labels),
        "mix": mixing.mix(df), "pack": packing.pack(df, packing_tokens), "join": jaccard_join.jaccard_join(df), "one": jaccard_join.one_per_class(df),
        "quality": quality_classifier.quality_scores(df, quality_classifier.fit(df, labels, "label")),
        "toxic": toxicity.toxicity(df, toxicity.fit(df, labels, "label")), "without": toxicity.without_toxic(df, toxicity.fit(df, labels, "label")),
        "urls": url_filter.url_filter(df.withColumnRenamed("text", "url").withColumnRenamed("n_chars", "label")),
    }
    got = {k: v.collect() for k, v in out.items()}
    for k in ("pii", "fingerprints", "rules", "join", "quality", "toxic", "without", "urls"):
        assert len(got[k]) == n, k
    assert set(df.columns) <= set(out["mix"].columns) and out["one"].columns == out["without"].columns == df.columns
    assert [c for c in df.columns if c != "pii"] == [c for c in out["pii"].columns if c != "pii"]
    if not rows:
        assert not any(got.values())
        return
    assert len(got["one"]) == 7 and sum(r["doc_id"] in (7, 8) for r in got["one"]) == 1
    assert len(got["pack"]) == sum(-(-(len(plain_words(t)) + 1) // 4096) for _, t, _ in rows)
    assert {r["component_id"] for r in got["join"] if r["doc_id"] in (7, 8)} == {7} and {r["component_id"] for r in got["join"] if r["doc_id"] == 5} == {5}
    assert len({r["score"] for r in got["quality"] if r["doc_id"] == 5}) == 1
    assert {r["text"] for r in got["pii"] if r["doc_id"] == 1} == {None} and {r["fingerprint"] for r in got["fingerprints"] if r["doc_id"] in (1, 2, 3)} == {""}
