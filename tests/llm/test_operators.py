"""Each operator against brute force or held-out labels, on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


# 1 fingerprints


def plain_print(text):
    """Sums by paragraph, in plain Python: (16 lanes of the paragraph's digest, signed counts of its runs of words)."""
    from colonnade.llm.text import mix, powers, word_hash

    exact, like = [0] * 16, [0] * 256
    for line in text.split("\n"):
        if line and not line.encode().isspace():
            digest = hashlib.shake_128(line.encode()).digest(64)
            exact = [(a + int.from_bytes(digest[4 * k : 4 * k + 4], "little")) % 2**32 for k, a in enumerate(exact)]
        w = [int(HASHES.setdefault(x, word_hash(x))) for x in words(line)]
        base = [int(x) for x in powers(8)]
        runs = [sum(w[i + j] * base[j + 1] for j in range(3)) for i in range(len(w) - 2)]
        if 0 < len(w) < 3:
            runs = [sum(x * base[j + 1] for j, x in enumerate(w)) + len(w)]
        for run in runs:
            h = int(mix(mix(np.array([run % 2**64], np.uint64)) ^ np.uint64(0xA0761D6478BD642F))[0])
            like[(h >> 1) & 255] += 1 - 2 * (h & 1)
    return exact, like


HASHES: dict = {}


def print_text(one):
    import base64

    return base64.b64encode(b"".join((x % 2**32).to_bytes(4, "little") for x in one[0] + one[1])).decode()


def plain_likeness(x, y):
    if x == y:
        return 1.0
    both = sum(a * b for a, b in zip(x[1], y[1]))
    most = sum(a * a for a in x[1]) + sum(b * b for b in y[1]) - both
    return min(1.0, max(0.0, both / most)) if most > 0 else 0.0


def test_fingerprints_of_repeated_and_null_ids(spark):
    from colonnade.llm import fingerprints as fp

    rows = [(7, f"text {k % 50}") for k in range(400)] + [(None, "no id"), (None, None), (3, "three"), (9, "nine")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fp.fingerprint_documents(table, parts=6).collect()
    assert Counter(r.doc_id for r in got) == {7: 400, None: 2, 3: 1, 9: 1}
    tie = {r.text: r.t for r in table.selectExpr("text", "xxhash64(coalesce(text, '')) as t").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = Counter()
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        want[i, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_fingerprints(spark, docs, rows, none, wide):
    from colonnade.llm import fingerprints as fp

    got = fp.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    tie = {r.text: r.t for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) as t").collect()}
    order = sorted(rows, key=lambda r: (-r[0], tie[r[1]]))
    for (i, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mine = [r for r in by_id[i] if r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert mine, i
        one = plain_print(text)
        assert mine[0].fingerprint == print_text(one) and mine[0].edited_fingerprint == print_text(plain_print(edited))
        assert mine[0].near_edited == pytest.approx(plain_likeness(one, plain_print(edited)))
        assert any(r.near_next == pytest.approx(plain_likeness(one, plain_print(after))) for r in mine)
    assert fp.fingerprint_documents(none).count() == 0
    assert fp.fingerprint_documents(docs.limit(1)).collect()[0].near_next == 1.0
    assert collect(fp.fingerprint_documents(wide)) == collect(fp.fingerprint_documents(docs))


def test_fingerprint_is_homomorphic():
    from colonnade.llm.fingerprints import delete, fingerprint, insert, likeness

    a, b, c = "first line here now", "second one is longer than that", "third"
    assert (fingerprint(f"{a}\n{b}\n{c}") == fingerprint(f"{c}\n{a}\n{b}")).all()
    assert (insert(fingerprint(f"{a}\n{b}"), c) == fingerprint(f"{a}\n{b}\n{c}")).all()
    assert (delete(fingerprint(f"{a}\n{b}\n{c}"), b) == fingerprint(f"{a}\n{c}")).all()
    assert (fingerprint(a) != fingerprint(f"{a}\n{a}")).any()
    many = lambda n: fingerprint("\n".join(["three same words"] * n))[None]
    assert likeness(many(65536), many(65535))[0] > 0.999 and likeness(many(100), many(50))[0] == pytest.approx(2 / 3, abs=0.01)
    rng = random.Random(1)
    one = [str(rng.random()) for _ in range(600)]
    two = one[:300] + [str(rng.random()) for _ in range(300)]
    x, y = fingerprint(" ".join(one)), fingerprint(" ".join(two))
    assert likeness(x[None], y[None])[0] == pytest.approx(1 / 3, abs=0.2)


# 2 quality


def test_quality(spark, docs, none, wide):
    from colonnade.llm import quality as q

    rng = random.Random(3)
    text = lambda bad: " ".join(("SHOUT!! " if bad else "calm words, ") + str(rng.randrange(99)) for _ in range(30))
    made = [(i, text(i % 5 == 0), "en", "s", 0) for i in range(400)]
    table = spark.createDataFrame(made, docs.schema)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = q.train(table, labels)
    got = {r.doc_id: r for r in q.score_documents(table, model).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        assert r.predicted == int(i % 5 != 0)
    assert q.score_documents(none, model).count() == 0
    assert q.score_documents(docs, model).count() == docs.count()
    assert q.keep_good(wide, model).columns == wide.columns
    untrained = q.train(table, labels.limit(0))
    assert {r.score for r in q.score_documents(docs, untrained).collect()} == {0.5}


def test_repeated_labelled_rows_count_once(spark, monkeypatch):
    from colonnade.llm import quality as q

    base = [(i, "good words here " * 5 if i % 2 else "BAD!!! " * 9) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    sizes = []
    fit = q.fit_pairs
    monkeypatch.setattr(q, "fit_pairs", lambda x, good, **k: sizes.append(len(x)) or fit(x, good, **k))
    for rows in (base, base + [(5, f"other {k}") for k in range(3000)]):
        q.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert sizes[0] == sizes[1] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))


def test_all_rows_and_pairs_are_fitted(spark, monkeypatch):
    """More labelled rows than any sample held; weights and threshold as from every pair, one by one."""
    from colonnade.llm import quality as q

    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.1] + [0, 2, 9]
    good = x[:, 0] + rng.normal(0, 0.6, 240) > 0.3
    z = (x - x.mean(0)) / x.std(0)
    diff = (z[good][:, None] - z[~good][None]).reshape(-1, 3)
    w = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-(diff @ w)))
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + q.RIDGE * np.eye(3)
        w -= np.linalg.solve(hessian, diff.T @ (p - 1) / len(diff) + q.RIDGE * w)
    order, bad = np.sort(z @ w), int((~good).sum())
    table = spark.createDataFrame([(list(map(float, r)), bool(g)) for r, g in zip(x, good)], "x array<double>, good boolean")
    for model in (q.fit_pairs(x, good), q.fit_pairs(q.Stored(table.repartition(5)), "good")):
        assert model.weights == pytest.approx(w, abs=1e-8)
        assert model.threshold == pytest.approx((order[bad - 1] + order[bad]) / 2, abs=1e-8)

    sizes = []
    fit = q.fit_pairs
    monkeypatch.setattr(q, "fit_pairs", lambda x, good, **k: sizes.append(len(x)) or fit(x, good, **k))
    docs = spark.range(32000).selectExpr("id as doc_id", "if(id % 3 = 0, 'BAD! ', 'good text ') || id as text")
    q.train(docs, docs.selectExpr("doc_id", "int(doc_id % 3 != 0) as quality"))
    assert sizes == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(32000))] and sizes[0] > 20_000


def test_order_statistics_of_stored_scores(spark):
    from colonnade.llm import quality as q

    for values in ([0.5, -2.0, 0.0, 1e-300, -1e9, 3.0, 3.0, 3.0], [7.0, 7.0, 7.0], [-1.0, -1.5]):
        table = spark.createDataFrame([([v], True) for v in values], "x array<double>, good boolean").repartition(3)
        want = sorted(values)
        for k in range(len(values) - 1):
            assert q.Stored(table).neighbours(lambda x: x[:, 0].copy(), k) == (want[k], want[k + 1])


def test_quality_on_the_test_tables(spark):
    """Held-out labels of sf0.1: the score parts them."""
    from colonnade.llm import quality as q

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = q.score_documents(docs, q.train(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in scored) / len(scored) > 0.95
    # The rank of good ones among all: area under the curve.
    order = sorted(scored, key=lambda r: r.score)
    good = [k for k, r in enumerate(order) if r.quality == 1]
    bad = len(order) - len(good)
    area = (sum(good) - len(good) * (len(good) - 1) / 2) / (len(good) * bad)
    assert area > 0.98


def test_pairs_learn_a_direction():
    from colonnade.llm.quality import fit_pairs

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    good = x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 0.3, 2000) > -0.8
    model = fit_pairs(x[:1000], good[:1000])
    assert ((model.score(x[1000:]) >= 0.5) == good[1000:]).mean() > 0.9


# 3 tokens


def test_token_store(spark, docs, rows, none, wide):
    import public_tokenizers
    from tokenizers import Tokenizer

    from colonnade.llm import token_store as ts
    from colonnade.llm.work import fresh_path

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    store = fresh_path(spark, "test-store")
    got = ts.encode_documents(docs, path, store).collect()
    assert all(r.verified for r in got) and len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    ids = defaultdict(list)
    for i, text, *_ in rows:
        ids[i].append([*plain.encode(text or "", add_special_tokens=False).ids, 2])
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[r.doc_id]]
    back = {r.start: list(r.ids) for r in ts.read_documents(spark, store).collect()}
    assert all(back[r.start] in ids[r.doc_id] for r in got)
    data = spark.read.parquet(f"{store}/data")
    assert data.filter("kind = 'chunk'").count() == data.filter("kind = 'chunk'").select("key").distinct().count()
    assert len(ts.store_root(spark, store)) == 64
    assert ts.encode_documents(none, path).count() == 0
    assert ts.encode_documents(wide, path).count() == len(rows)


def test_changed_files_are_noticed(spark, docs, tmp_path):
    import public_tokenizers
    from pyspark.sql import functions as F

    from colonnade.llm import token_store as ts

    some = docs.filter("doc_id < 60")
    n = some.count()
    store = f"{tmp_path}/store"
    ts.write_store(some, store, public_tokenizers.path("byte_bpe_50k.json"))

    def verified(name, change):
        """Documents still verified after ``change`` of one file; the file is put back."""
        import shutil

        kept = spark.read.parquet(f"{store}/{name}")
        shutil.copytree(f"{store}/{name}", f"{tmp_path}/kept")
        change(kept).write.parquet(f"{tmp_path}/new")
        shutil.rmtree(f"{store}/{name}")
        shutil.move(f"{tmp_path}/new", f"{store}/{name}")
        found = ts.read_summary(spark, store).filter("verified").count()
        shutil.rmtree(f"{store}/{name}")
        shutil.move(f"{tmp_path}/kept", f"{store}/{name}")
        return found

    assert verified("recipes", lambda d: d) == n
    one = F.col("doc_id") == 9
    # A leaf that fits its changed recipe still is not the one under the part's root.
    forged = F.udf(lambda i, k, d: ts.leaf(i, k, bytes(d)), "binary")
    assert verified("recipes", lambda d: d.withColumn("leaf", F.when(one, F.unhex(F.sha2("leaf", 256))).otherwise(F.col("leaf")))) < n
    shorter = lambda d: d.withColumn("n_tokens", F.col("n_tokens") - one.cast("int")).withColumn("leaf", forged("doc_id", "n_tokens", "digests"))
    assert verified("recipes", shorter) == 0
    assert verified("manifest", lambda d: d.withColumn("root", F.when(F.col("part") == 0, F.unhex(F.sha2("root", 256))).otherwise(F.col("root")))) < n
    assert verified("manifest", lambda d: d.withColumn("store_root", F.unhex(F.sha2("store_root", 256)))) == 0
    flip = F.concat(F.expr("substring(payload, 3)"), F.lit(b"\x01\x02"))
    chunk = F.col("kind") == "chunk"
    data = lambda d: d.withColumn("payload", F.when(chunk & (F.octet_length("payload") > 4), flip).otherwise(F.col("payload")))
    assert verified("data", lambda d: data(d).select(*ts._DATA.replace(",", "").split()[::2])) < n / 2


def test_roots_over_many_leaves(spark, monkeypatch):
    from colonnade.llm import token_store as ts

    monkeypatch.setattr(ts, "FAN", 3)
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(25)]
    rows = [(k % 2, k // 2, k, 10 + k, leaf) for k, leaf in enumerate(leaves)]
    table = spark.createDataFrame(rows, "part int, seq long, doc_id long, n_tokens long, leaf binary")

    def root(nodes):
        while True:
            nodes = [hashlib.sha256(b"\x01" + b"".join(nodes[k : k + 3])).digest() for k in range(0, len(nodes), 3)]
            if len(nodes) == 1:
                return nodes[0]

    got = {r.part: r for r in ts._manifest(table).collect()}
    assert [bytes(got[p].root) for p in (0, 1)] == [root(leaves[0::2]), root(leaves[1::2])]
    assert bytes(got[0].store_root) == root([root(leaves[0::2]), root(leaves[1::2])])
    assert got[1].start == got[0].n_tokens == sum(10 + k for k in range(0, 25, 2))


def test_ids_of_four_bytes(spark, docs, rows, tmp_path):
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    from colonnade.llm import token_store as ts

    large = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    large.add_tokens([AddedToken(f"<extra{k}>", normalized=False) for k in range(20_000)])
    large.save(f"{tmp_path}/large.json")
    texts = ["a <extra19999> b", "plain words", ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ts.encode_documents(table, f"{tmp_path}/large.json", f"{tmp_path}/store").collect()}
    for k, text in enumerate(texts):
        own = [*large.encode(text, add_special_tokens=False).ids, 2]
        assert (got[k].n_tokens, got[k].ids_crc32, got[k].verified) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()), True)
    assert max(max(r.ids) for r in ts.read_documents(spark, f"{tmp_path}/store").collect()) > 1 << 16
    with pytest.raises(ValueError):
        ts.write_store(table, f"{tmp_path}/no", f"{tmp_path}/large.json", end_id=1 << 20)


def test_pieces_equal_the_tokenizers_own(monkeypatch):
    import public_tokenizers

    from colonnade.llm import bytebpe
    from colonnade.llm.bytebpe import Encoder

    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    signs = ["a", "bc", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "½", "é", "漢", "!", "...", " ", "<|endoftext|>", "don't", "😀", "'S", "''ve", "'re", "'r", "'v", "averyveryverylongwordindeed", " qwertzuiopasdfghjklyxcvbnm"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(600)] + [""]
    for block in (texts, texts[::-1]):  # the second time from memory
        ids, counts = e.encode(block)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.tolist() for x in e._whole(block)]
    monkeypatch.setattr(bytebpe, "PART", 40)
    monkeypatch.setattr(bytebpe, "SLOTS", 8)
    e = bytebpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    long = [" ".join(rng.choice(signs) for _ in range(rng.randrange(400))) for _ in range(60)] + ["x" * 500, "a b" * 200]
    ids, counts = e.encode(long)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.tolist() for x in e._whole(long)]


def test_ids_are_those_of_the_unmodified_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from colonnade.llm import token_store as ts
    from colonnade.llm.bytebpe import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    signs = ["<|endoftext|>", "<|endoftext|", "|endoftext|>", "a", " ", "\n", "1", "'s", "é", "it's", "<", "|>"]
    rng = random.Random(4)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "plain", "", "<|endof", "text|>"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(300)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65]
    e = Encoder(path)
    for _ in range(2):
        ids, counts = e.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in ts.encode_documents(table, path).collect():
        own = [*want[r.doc_id], 2]
        assert (r.n_tokens, r.ids_crc32, r.verified) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()), True)


def test_chunks_follow_content():
    from colonnade.llm.token_store import LARGEST, chunk_ends, crc_of_pieces

    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50000, 30000).astype(np.uint16)
    ends, owner = chunk_ends(ids, np.array([10000, 0, 20000]))
    assert ends[-1] == 30000 and 10000 in ends and set(owner.tolist()) == {0, 2}
    assert np.diff(ends, prepend=0).max() <= LARGEST
    moved, _ = chunk_ends(np.concatenate([ids[:5], ids]), np.array([30005]))
    assert len(set((moved - 5).tolist()) & set(ends.tolist())) > 0.8 * len(ends)
    data = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 5, 1000, 1, 70000)]
    crc = crc_of_pieces(np.array([zlib.crc32(d) for d in data]), np.array([len(d) for d in data]), np.array([0, 2]))
    assert crc.tolist() == [zlib.crc32(b"".join(data[:2])), zlib.crc32(b"".join(data[2:]))]


# 4 personal data

#: The stated patterns, as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and max((len(p.lstrip("0")), p.lstrip("0")) for p in m[0].split(".")) > (3, "255"):
                continue
            if kind == "card":
                double = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(double) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_personal_data(spark, docs, rows, none, wide):
    from colonnade.llm import pii

    texts = [
        "write to a.b@mail.example.com or 10.0.0.256, 10.1.2.3", "card 4111 1111 1111 1111 and 4111 1111 1111 1112",
        "call +1 (499) 555-6503 now", "nothing 2024-01-15 v1.2.3 here", None, "é" * 50 + " x@y.zz", "+1 23",
        "1" * 5000 + "@" + "2" * 5000 + ".1.2.3",
    ]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(table).collect()}
    assert (got[0].n_email, got[0].n_ip) == (1, 1) and "ip:45:53" in got[0].spans
    assert got[1].n_card == 1 and got[2].n_phone == 1 and got[3].spans == "" and got[4].spans == ""
    assert "email:51:57" in got[5].spans
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii._shown(base).encode()).hexdigest()
        assert {pii._shown([s]) for s in base} <= set(got[i].spans.split(",")) or not base
    assert pii.find_personal_data(none).count() == 0
    assert pii.find_personal_data(wide).count() == len(rows)


def test_sequence_model_gradients_and_accuracy():
    from colonnade.llm import pii
    from colonnade.llm.sequence_model import BiLstmCrf

    m = BiLstmCrf(6, 3, np.ones((3, 3), bool), embed=4, hidden=3)
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 6, (2, 5)), rng.integers(0, 3, (2, 5))
    _, grad = m.loss_and_gradients(s, y)
    for k, g in grad.items():
        at = tuple(int(rng.integers(0, d)) for d in g.shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-5
        up = m.loss_and_gradients(s, y)[0]
        m.p[k][at] = old - 1e-5
        down = m.loss_and_gradients(s, y)[0]
        m.p[k][at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def tagged(text):
    """(kind, start, end) that the model gives over the whole text."""
    from colonnade.llm import pii

    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    parts = pii.stretches(text, code)
    tags = pii.tag_stretches(pii.trained_model(), [pii.symbols(code[a:b]) for a, b in parts])
    return {(k, x + a, y + a) for (a, _), t in zip(parts, tags, strict=True) for k, x, y in pii.spans_of(t)}


def test_held_out_spans():
    from colonnade.llm import pii

    rng = np.random.default_rng(990)
    both = found = labelled = 0
    for _ in range(40):
        text, tags = pii.sample_text(rng, 1500)
        want, got = set(pii.spans_of(np.array(tags, np.int8))), tagged(text)
        both, found, labelled = both + len(want & got), found + len(got), labelled + len(want)
    assert 2 * both / (found + labelled) > 0.9


def test_base_patterns_are_the_stated_ones_and_linear():
    import time

    from colonnade.llm import pii

    rng = random.Random(12)
    bits = ["a", "b.c", "@", ".", "-", "1", "22", "4111 1111 1111 1111", "+1", " ", "(2) ", "300", "é", "\n", "x@y.zz", "10.0.0.1", "9" * 15]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(text) == plain_spans(text), text
    n = 1_000_000
    for text in ("1" * n, "a" * n, "1." * (n // 2), "a@" * (n // 2), "1 " * (n // 2), "+1" + " " * n, "+1" * (n // 2), "a." * (n // 2) + "@"):
        began = time.perf_counter()
        pii.base_spans(text)
        assert time.perf_counter() - began < 20, text[:4]


def test_stretches_hold_every_span():
    from colonnade.llm import pii

    rng = np.random.default_rng(5)
    for _ in range(60):
        text, tags = pii.sample_text(rng, 800)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        parts = pii.stretches(text, code)
        assert parts == sorted(parts) and all(b <= c for (_, b), (c, _) in zip(parts, parts[1:]))
        for k, lo, hi in pii.spans_of(np.array(tags, np.int8)):
            assert any(a <= lo and hi <= b for a, b in parts), (k, text[lo:hi])


def test_best_path_over_whole_stretches():
    from itertools import product

    from colonnade.llm.sequence_model import BiLstmCrf

    rng = np.random.default_rng(3)
    allowed = np.ones((3, 3), bool)
    allowed[0, 2] = False
    m = BiLstmCrf(4, 3, allowed, embed=3, hidden=2)
    scores = [rng.normal(size=(n, 3)).astype(np.float32) for n in (1, 4, 6, 2, 6)]
    trans = m.p["T"] + m.barred
    for at_once in (1, 8, 1 << 20):
        for u, got in zip(scores, m.best_paths(scores, at_once), strict=True):
            value = lambda y: sum(u[t, y[t]] for t in range(len(y))) + sum(trans[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
            assert value(got) == pytest.approx(max(value(y) for y in product(range(3), repeat=len(u))), abs=1e-4)


def test_windows_are_reconciled(spark):
    from colonnade.llm import pii

    text = "x " * 40 + "mail bob@example.com " * 9 + "y " * 40
    spans = [text[x:y] for _, x, y in tagged(text)]
    assert spans.count("bob@example.com") >= 8
    # One stretch of 200,000 characters, and forms that only the model finds.
    long = "call (499) 555-6503 or " * 9000
    cases = ["write to jane [at] example [dot] com please", "an office line (499) 555-6503 today", "jörg.müller@exämple.de wrote", long]
    table = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(table).collect()}
    assert got[0].spans == "email:9:36" and got[1].spans == "phone:15:29" and got[2].n_email == 0
    assert [got[i].n_phone for i in range(4)] == [0] * 4 and got[3].n_added > 8500


# 5 near duplicates


def brute_classes(rows, near_dups):
    n = len(rows)
    tf = []
    for r in rows:
        w = words(r[1])
        tf.append(Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    df = Counter(s for c in tf for s in c)
    top = math.log1p(1 / near_dups.SHARE)
    weight = [{s: (1 + math.log(k)) * min(1, math.log1p(n / df[s]) / top) for s, k in c.items()} for c in tf]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = weight[i], weight[j]
            both = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
            if (rows[i][1] or "") == (rows[j][1] or "") or both and both / (sum(a.values()) + sum(b.values()) - both) >= 0.8:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    return groups


@pytest.mark.parametrize(("leaders", "small", "tile"), [(2, 32, 512), (0, 1, 8)])
def test_near_duplicates(spark, docs, rows, leaders, small, tile, monkeypatch):
    from colonnade.llm import near_dups

    monkeypatch.setattr(near_dups, "LEADER_ROUNDS", leaders)
    monkeypatch.setattr(near_dups, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dups, "TILE", tile)
    got = near_dups.near_duplicates(docs).collect()
    groups = brute_classes(rows, near_dups)
    want = sorted((rows[i][0], min(rows[j][0] for j in g)) for g in groups.values() for i in g)
    assert sorted((r.doc_id, r.class_id) for r in got) == want
    assert sum(r.keep for r in got) == len(groups)
    assert all(r.doc_id == r.class_id for r in got if r.keep)


def test_near_duplicates_edges(spark, docs, none, wide):
    from colonnade.llm import near_dups

    assert near_dups.near_duplicates(none).count() == 0
    kept = near_dups.keep_first_of_class(wide)
    assert kept.columns == wide.columns
    assert kept.count() == near_dups.near_duplicates(docs).filter("keep").count()


def test_samples_estimate_weighted_jaccard():
    from colonnade.llm import near_dups

    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    x, y = np.arange(0, 240), np.arange(40, 300)
    w = 1 + np.log(rng.integers(1, 5, 300))
    k = 2000
    a = near_dups.signatures(h[x], w[x], np.array([0]), k)
    b = near_dups.signatures(h[y], w[y], np.array([0]), k)
    true = near_dups.weighted_jaccard((h[x], w[x]), (h[y], w[y]))
    assert (a == b).mean() == pytest.approx(true, abs=0.05)


def test_samples_of_long_texts():
    """More shingles than table entries: ties are broken alike in both texts."""
    from colonnade.llm import near_dups

    rng = np.random.default_rng(9)
    h = np.sort(rng.integers(0, 1 << 62, 400_000).astype(np.uint64))
    k = near_dups.ROWS * near_dups.BANDS
    agree = []
    for shift in (0, 20_000, 40_000):
        x, y = h[: 360_000 - shift], h[40_000 - shift :]
        a, b = (near_dups.signatures(z, np.ones(len(z)), np.array([0]), k) for z in (x, y))
        near = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        agree.append((a == b).mean() - near)
    assert max(map(abs, agree)) < 0.15


def test_common_shingles_are_exact_in_any_batches(spark):
    from colonnade.llm import near_dups

    rng = random.Random(2)
    often = [" ".join(f"o{k}x{j}" for j in range(5)) for k in range(4)]
    texts = [" ".join(o for k, o in enumerate(often) if rng.random() < (0.1, 0.24, 0.3, 0.9)[k]) + f" end{i}" for i in range(300)]
    df = Counter(s for t in texts for s in {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)})
    want = sorted(math.log1p(300 / n) / math.log1p(4) for n in df.values() if n > 75)
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    for parts in (1, 40, 300):
        keys, idf = near_dups.common_shingles(table.repartition(parts), 300)
        assert sorted(idf.tolist()) == pytest.approx(want) and len(keys) == len(want)


def test_components_of_a_chain(spark):
    from colonnade.llm.near_dups import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# 6 decontamination


def test_decontamination(spark, docs, none, wide):
    from colonnade.llm import decontamination as dc

    rng = random.Random(8)
    item = [f"w{rng.randrange(10**6)}" for _ in range(30)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(30)]
    near = list(item)
    for k in (4, 13, 22):
        near[k] = "changed"
    filler = [f"f{k}" for k in range(50)]
    cases = {
        1: " ".join(filler + item + filler), 2: "Intro.\n" + ", ".join(near).upper(), 3: " ".join(item[:15] + filler),
        4: " ".join(item[:6] + filler + item[20:25]), 5: " ".join(filler), 6: "short one", 7: None, 8: " ".join(item[k] for k in range(0, 30, 2)),
        9: " ".join(filler + other + item),
    }
    table = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other)), (12, ""), (13, None), (14, "short one")], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in dc.contaminated(table, bench).collect()}
    assert got == {1: "10", 2: "10", 3: "10", 6: "14", 9: "10,11"}
    assert sorted(r.doc_id for r in dc.without_leaks(table, bench).collect()) == [4, 5, 7, 8]
    assert dc.contaminated(none, bench).count() == 0 and dc.contaminated(table, bench.limit(0)).count() == 0
    assert dc.without_leaks(wide, bench).columns == wide.columns


def test_benchmark_in_blocks(spark, monkeypatch):
    from colonnade.llm import decontamination as dc

    monkeypatch.setattr(dc, "BENCHMARK_WORDS", 20)
    items = [(k, " ".join(f"t{k}x{j}" for j in range(20))) for k in range(5)]
    table = spark.createDataFrame([(k, "pre " + t + " post") for k, t in items], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in dc.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: str(k) for k in range(5)}


def test_replaced_words_anywhere(spark):
    from itertools import combinations

    from colonnade.llm import decontamination as dc

    cases, items = [], []
    for n in range(4, 21):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for m in range(1, n // 4 + 2):
            every = list(combinations(range(n), m))
            for k, places in enumerate(every if len(every) < 300 else random.Random(n).sample(every, 300)):
                text = " ".join("no" if j in places else w for j, w in enumerate(item))
                same = [j not in places for j in range(n)]
                whole = any(4 * sum(same[a:b]) >= 3 * (b - a) for a in range(n) for b in range(a + min(13, n), n + 1))
                cases.append((len(cases), f"pre{k} {text} post", n, whole))
    table = spark.createDataFrame(cases, "doc_id long, text string, n long, whole boolean")
    got = {r.doc_id: r["items"] for r in dc.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    lost = [(n, text) for i, text, n, whole in cases if got.get(i) != (str(n) if whole else None)]
    assert not lost, (len(lost), len(cases), lost[:3])


def coded(text, number):
    return np.array([number.setdefault(w, len(number)) for w in words(text)], np.int64)


def plain_leak(text, goal):
    """Whether some alignment has a stretch of 13 words, or of the whole shorter item, with three quarters equal."""
    least = min(13, len(goal))
    if not least or not np.isin(text, goal).any():
        return False
    equal = np.zeros((len(text) + 2 * len(goal), len(goal)), bool)
    equal[len(goal) : len(goal) + len(text)] = text[:, None] == goal
    for zero in range(-len(goal) + 1, len(text)):
        lo, hi = max(0, -zero), min(len(goal), len(text) - zero)
        same = equal[len(goal) + zero + np.arange(lo, hi), np.arange(lo, hi)]
        if same.sum() < 0.75 * least:
            continue
        gain = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
        if any((gain[least + a :] >= gain[a]).any() for a in range(len(gain) - least)):
            return True
    return False


def test_leaks_of_the_test_tables(spark):
    """Every pair of a document and an item of sf0.001, by all alignments."""
    from colonnade.llm import decontamination as dc

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 4000")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    number: dict = {}
    goals = {r.item_id: coded(r.text, number) for r in items.collect()}
    texts = {r.doc_id: coded(r.text, number) for r in docs.collect()}
    want = {(i, k) for i, text in texts.items() for k, goal in goals.items() if plain_leak(text, goal)}
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, items).collect()}
    assert got == want and want


def test_repeated_rows_and_null_ids(spark):
    from colonnade.llm import decontamination as dc

    leak = " ".join(f"w{k}" for k in range(20))
    long = " ".join(["of the and"] * 2_000) + " " + leak
    rows = [(1, leak), (1, leak), (1, "clean words"), (None, leak), (None, "x"), (2, long), (3, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(5, leak), (5, leak), (None, "of the and of the"), (6, " ".join(["of the and"] * 20))], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in dc.contaminated(table, items).collect()}
    assert got == {1: "5", None: "5", 2: "-1,5,6"}
    kept = Counter((r.doc_id, r.text) for r in dc.without_leaks(table, items).collect())
    assert kept == {(1, "clean words"): 1, (None, "x"): 1, (3, ""): 1}


def test_light_masks_miss_no_stretch():
    from itertools import combinations

    from colonnade.llm import decontamination as dc

    # Longer stretches part into two, one of them with the share; fewer words with as many replaced are the hardest.
    for n in [*range(4, 14), 16, 20, 24]:
        masks = [int(m[::-1], 2) for m in (dc.LIGHT if n >= dc.OVERLAP else dc.LIGHTEST)]
        shifted = [m << k for m in masks for k in range(n - m.bit_length() + 1)]
        for places in combinations(range(n), n // 4):
            gone = sum(1 << k for k in places)
            assert any(not m & gone for m in shifted), (n, places)


# 7 licenses


def test_licenses(spark, docs, rows, none, wide):
    from colonnade.llm import licenses as lic

    notice = lic.NOTICES["bsd_notice"]
    lines = ["x\n" + notice, notice.replace("binary", "compiled").replace("source", "code") + "\ny", " ".join(notice.split()[:8]),
             "The MIT License and the General Public License; MIT\nlicense", "mit licenses", None, "", "apache-license " * 3]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r for r in lic.scan_licenses(table).collect()}
    assert got[0].labels == "bsd_notice" and got[0].score == 1.0 and got[0].base_labels == ""
    assert got[1].labels == "bsd_notice" and 0.8 <= got[1].score < 1 and got[2].labels == ""
    assert got[3].base_labels == "gpl,mit" and (got[3].n_base, got[3].first_word, got[3].last_word) == (3, 1, 8)
    assert got[4].n_base == 0 and got[5].n_words == 0 and got[7].n_base == 3
    for (i, text, *_) in rows:
        w = words(text)
        mine = [r for r in lic.scan_licenses(docs.filter(f"doc_id = {i}")).collect()] if i in (3, 3005, 3007) else []
        assert not mine or len(w) in [r.n_words for r in mine]
    assert lic.scan_licenses(none).count() == 0 and lic.scan_licenses(wide).count() == len(rows)


def test_license_join_is_exact():
    from colonnade.llm import licenses as lic
    from colonnade.llm.text import Words

    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(30)]
    notices = {f"n{k}": " ".join(rng.sample(vocabulary, rng.randrange(3, 9))) for k in range(12)}
    frequency = {int(Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hash[0]): rng.randrange(100) for w in vocabulary}
    for threshold in (0.5, 0.8, 1.0):
        join = lic.Join(notices, frequency, threshold)
        lines = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 14))) for _ in range(300)]
        raw = "\n".join(lines).encode()
        data = np.frombuffer(raw, np.uint8)
        w = Words(data, np.array([0, len(raw)]))
        line = np.searchsorted(np.flatnonzero(data == 10), w.start)
        got = sorted((label, round(share, 9)) for _, label, share in join.lines(w, line))
        want = sorted(
            (label, round(len(set(x.split()) & set(t.split())) / len(set(t.split())), 9))
            for x in lines for label, t in notices.items()
            if len(set(x.split()) & set(t.split())) >= threshold * len(set(t.split())) - 1e-9
        )
        assert got == want


def test_positional_filter_prunes():
    from colonnade.llm import licenses as lic

    vocabulary = [f"w{k}" for k in range(12)]
    hashes = {w: int(lic.word_hash(w)) for w in vocabulary}
    frequency = {hashes[w]: k for k, w in enumerate(vocabulary)}  # w0 is the rarest
    join = lic.Join({"n": " ".join(vocabulary[2:])}, frequency, 0.8)
    held = lambda *ks: {hashes[f"w{k}"] for k in ks}
    far = {10**6 + k for k in range(10)}  # words of no notice: long enough, nothing to find
    assert join.candidates(held(*range(2, 12))) == [0]
    assert join.candidates(held(2, 5, 6) | far) == []
    assert join.candidates(held(4, *range(5, 12)) | far) == [0] and join.candidates(held(11) | far) == []


def test_wrapped_notices(spark):
    import textwrap

    from colonnade.llm import licenses as lic

    marks = ["", "# ", " * ", "// ", "-- ", "dnl ", "REM "]
    cases = [
        (label, "some code\n\n" + textwrap.fill(notice, 70, initial_indent=m, subsequent_indent=m) + f"\n{m}and more words follow")
        for label, notice in lic.NOTICES.items() for m in marks
    ]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in lic.scan_licenses(table).collect()}
    for i, (label, text) in enumerate(cases):
        assert label in got[i].labels.split(",") and got[i].score == 1.0, text


def test_runs_of_words_are_exact():
    from colonnade.llm import licenses as lic
    from colonnade.llm.text import Words

    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(30)]
    notices = {f"n{k}": " ".join(rng.choices(vocabulary, k=rng.randrange(3, 12))) for k in range(12)}
    texts = [rng.choices(vocabulary, k=rng.randrange(40)) for _ in range(200)]
    raw = ["\n".join(t).encode() for t in texts]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for threshold in (0.5, 0.8, 1.0):
        want = set()
        for k, text in enumerate(texts):
            for label, notice in notices.items():
                goal, size = set(notice.split()), math.ceil(lic.SPREAD * len(notice.split()))
                most = max(len(goal & set(text[a : a + size])) for a in range(len(text) + 1))
                if most >= threshold * len(goal) - 1e-9:
                    want.add((k, label, round(most / len(goal), 9)))
        assert {(t, label, round(x, 9)) for t, label, x in lic.Join(notices, {}, threshold).runs(words)} == want and want


# 8 shards


def test_hilbert_shards(spark, docs, rows, none, wide):
    from colonnade.llm import hilbert_shards as hs

    got = hs.hilbert_shards(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    place = lambda xs: {v: k for k, v in enumerate(sorted(xs, key=lambda v: (v is not None, v or "")))}
    langs, sources = place({r[2] for r in rows}), place({r[3] for r in rows})
    lowest = {}
    for i, t, lang, source, _ in sorted(rows, key=lambda r: (r[0], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        lowest.setdefault(zlib.crc32((t or "").encode()), (langs[lang], sources[source], min(15, (len((t or "").encode()) + 1).bit_length() - 1)))
    assert all(r.curve_index == hs.hilbert_position(lowest[r.text_crc32], hs.BITS) for r in got)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve_index for r in order] == sorted(r.curve_index for r in got)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert hs.hilbert_shards(none).count() == 0
    assert sorted(r.shard for r in hs.hilbert_shards(wide.limit(3)).collect()) == sorted({-(-(k + 1) * 8 // 3) - 1 for k in range(3)})


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 3), (4, 2)])
def test_curve_steps_to_neighbours(dims, bits):
    from itertools import product

    from colonnade.llm.hilbert_shards import hilbert_position

    at = {hilbert_position(p, bits): p for p in product(range(1 << bits), repeat=dims)}
    assert sorted(at) == list(range(1 << dims * bits))
    assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1])) == 1 for k in range(len(at) - 1))


# 9 secrets


def test_secrets(spark, docs, rows, none, wide):
    from colonnade.llm import secrets as sc

    texts = ["password = 'abcdefghijkl'", "secret: token: abcdefghijklmnop", "AKIAABCDEFGHIJKLMN0 x", "deadbeefdeadbeef", None, "",
             "\u0001 API_KEY: zzzzzzzzzzzzzzzz \u0001", "key ghp_a8Kd93jfLw02mQzX71bVtY5 end", "order_item_total_2024_part", "é token=abcdefghijkl"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ratio = sc.train(sc.labelled_samples(spark))
    got = {r.doc_id: r for r in sc.scan_secrets(table, ratio).collect()}
    assign = re.compile(sc.BASE["assign"].replace("(?i:", "(?:"), re.I)
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        shown = [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(got[i].spans.split(",")) or not shown
    assert got[7].spans == "random:4:31" and got[8].spans == ""
    assert sc.scan_secrets(none, ratio).count() == 0 and sc.scan_secrets(wide, ratio).count() == len(rows)


def test_all_spans_against_plain_python(spark, docs, rows):
    """Base and added spans of the fixture, of random texts and of very long ones."""
    import string

    from colonnade.llm import secrets as sc

    ratio = sc.train(sc.labelled_samples(spark))
    n = len(sc.ALPHABET)
    rng = random.Random(21)
    bits = [" ", "password=", "secret: ", "AKIA", "deadbeef00112233", "api_key ='", "'", "\u0001", "é", "\n", "-", "some_long_identifier_name", "0123456789"]
    key = lambda k: "".join(rng.choices(string.ascii_letters + string.digits, k=k))
    texts = [r[1] for r in rows] + ["".join(rng.choice([*bits, key(rng.randrange(30))]) for _ in range(rng.randrange(30))) for _ in range(150)]
    texts += [" ".join(key(12 + k % 9) for k in range(3000)), "a" * 1_000_000, "x=" * 100_000, "token=" + "b7" * 200_000]
    patterns = {
        "assign": re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
        "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
    }

    def plain(t):
        base = []
        for order, (kind, pattern) in enumerate(patterns.items()):
            for m in pattern.finditer(t):
                if len(m[1] if kind == "assign" else m[0]) >= sc.LEAST[kind]:
                    base.append((m.start(), order, m.end(), kind))
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t):
            if len(m[0]) < sc.LONG or any(a < m.end() and b > m.start() for a, _, b, _ in base):
                continue
            at = [sc.ALPHABET.index(c) for c in m[0]]
            mean = sum(round(ratio[x * n + y], 6) for x, y in zip(at, at[1:])) / (len(at) - 1)
            if abs(mean - sc.MARGIN) < 1e-9 or mean > sc.MARGIN:
                more.append((m.start(), 3, m.end(), "random"))
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(base + more))

    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.spans for r in sc.scan_secrets(table, ratio).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t or ""), (i, (t or "")[:80])


def test_models_part_held_out_strings(spark):
    from pyspark.sql import functions as F

    from colonnade.llm import secrets as sc

    samples = sc.labelled_samples(spark).filter("length(value) >= 16").withColumn("fold", F.pmod(F.xxhash64("value"), F.lit(4)))
    ratio = sc.train(samples.filter("fold > 0").select("random", "value"))
    held = samples.filter("fold = 0").select("random", (sc.log_ratio(F.col("value"), ratio) > sc.MARGIN).alias("hit"))
    right = [r.random == r.hit for r in held.collect()]
    assert sum(right) / len(right) > 0.98


def test_recall_through_the_scan(spark):
    import string

    from colonnade.llm import secrets as sc

    rng = random.Random(11)
    letters, all_of = string.ascii_letters, string.ascii_letters + string.digits
    kinds = [(letters, 24), (letters, 32), (all_of, 12), (all_of, 14), (all_of, 16), (all_of + "+/", 16), (letters[26:] + "234567", 16)]
    keys = [(k, "".join(rng.choices(alphabet, k=n))) for k, (alphabet, n) in enumerate(kinds) for _ in range(200)]
    plain = (  # no word of these is among the samples
        "Internationalization characterization incomprehensible Weltanschauung Bundeskanzleramt Gemeinschaftskunde "
        "anticonstitutionnellement gouvernementale extraordinariamente constitucionalmente precipitevolissimevolmente "
        "getUserAccountName read_only_property some-long-file-name ================ ---------------- 1234567890123456"
    ).split()
    texts = [f"the {v} end" for _, v in keys] + [f"the {w} end" for w in plain]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in sc.scan_secrets(table, sc.train(sc.labelled_samples(spark))).collect()}
    found = Counter(k for i, (k, v) in enumerate(keys) if f":4:{4 + len(v)}" in got[i])
    assert all(found[k] >= 196 for k in range(len(kinds))), found
    for i, w in enumerate(plain, len(keys)):
        assert "random" not in got[i], w


# 10 mixing


def test_mix(spark, docs, rows, none, wide):
    from colonnade.llm import mixing

    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, count(t)) for i, t, *_ in rows)
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = {s: sum(count(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: float(1 + k % 3) for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * size[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= full
    for s in sources:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(target[s]) and own[0].source_size == size[s]
        assert sum(r.taken for r in own) == pytest.approx(target[s], abs=1)
        assert all(0 <= r.taken <= 3 * r["size"] for r in own)
    assert collect(mixing.mix_sources(docs)) == collect(mixing.mix_sources(docs))
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_sources(wide).count() == len(rows)


def test_schedule_is_even(spark):
    """In every run of slots each source has its share, but for a few."""
    from colonnade.llm import mixing

    targets = [(1, 50_000.0), (2, 20_000.0), (3, 25_000.0), (4, 5_000.0)]
    table = spark.createDataFrame(targets, "source_rank int, target double")
    slots = sorted(mixing.schedule(table, 10).collect(), key=lambda r: r.slot)
    assert [r.slot for r in slots] == list(range(len(slots)))
    for rank, target in targets:
        mine = np.array([r.source_rank == rank for r in slots])
        assert [r.block for r in slots if r.source_rank == rank] == list(range(mine.sum()))
        ahead = np.concatenate([[0], np.cumsum(mine) - target / 100_000 * np.arange(1, len(mine) + 1)])
        assert ahead.max() - ahead.min() < 8  # random slots would stray by about 100
    # The points themselves, in whole numbers of any size.
    got = spark.range(3).selectExpr(f"(cast(id + {10**14} as decimal(17,0)) * {mixing.GOLDEN}BD + {mixing.UNIT // 2}BD) % {mixing.UNIT}BD as x").collect()
    assert [int(r.x) for r in got] == [((10**14 + k) * mixing.GOLDEN + mixing.UNIT // 2) % mixing.UNIT for k in range(3)]


def test_slots_of_documents(spark, docs):
    from colonnade.llm import mixing

    got = mixing.mix_sources(docs).collect()
    assert all((r.first_slot is None) == (r.taken == 0) == (r.n_slots == 0) for r in got)
    # Slots are dealt over the sources from the start on.
    whole = sum({r.source: r.target for r in got}.values())
    for source, target in {r.source: r.target for r in got if r.taken}.items():
        assert min(r.first_slot for r in got if r.source == source and r.taken) <= 2 * whole / target + 4


def test_tiny_sources_beside_huge_ones_have_their_slots(spark):
    from colonnade.llm import mixing

    for tiny in (100, 300, 1000, 5000):
        sizes = [60_000_000, 40_000_000, 40_000_000, tiny, 30_000_000, tiny]
        table = spark.createDataFrame([(False, f"s{k}", n) for k, n in enumerate(sizes)], "_null boolean, _key string, size long")
        targets = mixing.source_targets(table).cache()
        blocks = defaultdict(list)
        for r in mixing.schedule(targets, mixing.BLOCK_WORDS).collect():
            blocks[r.source_rank].append(r.block)
        for r in targets.collect():
            assert r.target == 3 * tiny or r.source_size > tiny
            assert sorted(blocks[r.source_rank]) == list(range(len(blocks[r.source_rank])))
            assert len(blocks[r.source_rank]) * mixing.BLOCK_WORDS >= math.floor(r.target)


def test_tiny_sources_are_taken_to_the_word(spark, monkeypatch):
    from colonnade.llm import mixing

    monkeypatch.setattr(mixing, "SLOTS_EACH", 8)  # blocks of 4096 words on small tables
    sizes = {"a": 60_000, "b": 50_000, "c": 50_000, "d": 10, "e": 60_000, "f": 10}
    rows = [(k, "w " * (n // 10), s) for s, n in sizes.items() for k in range(10)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target["d"] == target["f"] == 30.0
    assert taken == {s: math.floor(x) for s, x in target.items()}


def test_running_sum(spark):
    from pyspark.sql import functions as F

    from colonnade.llm.ranks import running_sum

    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("c"), (F.col("id") % 5).alias("d"), F.lit(2).alias("v"))
    got = running_sum(df, ["g"], ["c", "d"], ["id"], "v", "out").collect()
    want, sums = {}, Counter()
    for r in sorted(df.collect(), key=lambda r: (r.g, r.c, r.d, r.id)):
        want[r.id] = sums[r.g]
        sums[r.g] += r.v
    assert {r.id: r.out for r in got} == want
