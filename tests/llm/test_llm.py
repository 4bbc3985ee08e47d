"""The training-data operators against brute force, round trips, and SQL; edge cases of each."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry
from tamiz.llm import (
    components, exact_dedup, langid, mixing, packing, quality_rules, simhash, substring_dedup, token_counts, vocabulary, warc, weak_quality,
)
from tamiz.llm.base import read
from tests.compare import differences, oracle

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


def odd_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and thing{i}." for i in range(30_000))
    text = "One two three four five six seven eight nine ten, eleven twelve. Thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone."
    return [
        (1, text, "en", "a"), (2, text.replace(" ", "\n\t"), "en", "b"), (2, text, "en", "a"), (2, text, "en", "a"),
        (3, None, "en", "a"), (4, "", None, None), (5, " \t", "fr", "a"), (None, text, "en", None), (None, None, None, None),
        (6, long, "en", "c"), (7, long + " end", "de", "c"), (8, text + " more", "en", "a"), (9, "12 34 !!", "en", "a"),
        (10, "été déjà " * 40, "fr", "b"), (11, "x" * 5000, "en", "b"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows())


@pytest.fixture(scope="module")
def small(spark):
    return read(spark, SF, "documents")


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# --- SQL twins and registration


@needs_tables
@pytest.mark.parametrize("name", ["op4_exact_dedup", "op9_warc"])
def test_sql_twins(spark, name):
    con = oracle(SF)
    assert differences(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


# --- exact dedup


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return groups


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_exact_groups(spark, odd, block):
    rows = [(r[0], r[1]) for r in odd_rows()]
    groups = exact_brute(rows)
    got = exact_dedup.exact_groups(odd.select("doc_id", "text"), block_bytes=block).collect()
    assert len(got) == len(rows)
    want = Counter()
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(body.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_copies_keeps_columns(spark, odd, empty):
    from pyspark.sql import functions as F

    clash = odd.withColumn("_id", F.lit("mine")).withColumn("kept", F.lit(3)).withColumn("_sha", F.lit(1))
    out = exact_dedup.drop_copies(clash)
    assert out.columns == clash.columns
    rows = out.collect()
    assert len(rows) == len(exact_brute([(r[0], r[1]) for r in odd_rows()]))
    assert all(r["_id"] == "mine" and r["kept"] == 3 for r in rows)
    assert exact_dedup.drop_copies(empty).count() == 0


# --- SimHash


def print_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    spans = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def link_brute(prints, bits=3):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= bits:
            parent[root(a)] = root(b)
    return {p: root(p) for p in parent}


@pytest.mark.parametrize("crowd", [2, 1024])
def test_near_components(spark, odd, crowd):
    rows = [(r[0], r[1]) for r in odd_rows()]
    prints = [print_brute(t) for _, t in rows]
    roots = link_brute(prints)
    low = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        low[roots[p]].append(i)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in low.items()}
    got = simhash.near_components(odd, crowd=crowd).collect()
    want = Counter((i, p, low[roots[p]]) for (i, _), p in zip(rows, prints))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


@pytest.mark.parametrize("crowd", [3, 20, 1024])
def test_links_of_crowded_keys(spark, crowd):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 4).tolist()
    prints = {c for c in centres} | set(rng.integers(0, 1 << 63, 60).tolist())
    for c in centres:
        for _ in range(60):
            value = c
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                value ^= 1 << int(bit)
            prints.add(value)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowd=crowd)
    assert all((r.a % (1 << 64) ^ r.b % (1 << 64)).bit_count() <= 3 for r in links.collect())
    found = {r.node % (1 << 64): r.root for r in components.components(links).collect()}
    want = link_brute(prints)
    sets = lambda m: {frozenset(k for k in prints if m.get(k, k) == v) for v in {m.get(k, k) for k in prints}}
    assert sets(found) == sets(want)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 999), (5000, 5000)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 999: 999, 1000: 999}


def test_drop_near_copies(spark, odd, empty):
    from pyspark.sql import functions as F

    out = simhash.drop_near_copies(odd.withColumn("fp", F.lit("x")).withColumn("_nth", F.lit("y")))
    assert out.columns[-2:] == ["fp", "_nth"]
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids))
    assert 1 in ids and 2 not in ids
    assert simhash.drop_near_copies(empty).count() == 0


# --- repeated substrings


def spans_brute(rows, length):
    """(id, removed mask) per row in input order; rows sorted by id, then text hash as the operator defines."""
    seen, out = set(), []
    for i, raw in rows:
        mask = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - length + 1):
            part = raw[s : s + length]
            if part in seen:
                mask[s : s + length] = True
            seen.add(part)
        out.append((i, raw, mask))
    return out


def removal_rows(rows, length):
    want = Counter()
    for i, raw, mask in spans_brute(rows, length):
        runs = int(np.diff(mask.astype(int), prepend=0).clip(0).sum())
        kept = hashlib.sha256(bytes(b for b, m in zip(raw, mask) if not m)).hexdigest()
        want[(i, len(raw), int(mask.sum()), runs, kept)] += 1
    return want


def removed(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


@given(st.binary(max_size=900).map(lambda b: bytes(97 + x % 3 for x in b)))
@settings(max_examples=100, deadline=None)
def test_phrases_hold_every_string_once(raw):
    _, at, starts, counts = substring_dedup.phrases(raw)
    got = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts)]) if len(starts) else np.zeros(0)
    assert got.tolist() == list(range(max(0, len(raw) - 99)))
    assert all(s + c - 1 <= t <= s + 68 for t, s, c in zip(at, starts, counts))


def test_remove_repeats(spark, odd, empty):
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passages = [letters(n) for n in (99, 100, 101, 140, 400)]
    rows = []
    for i in range(60):
        parts = [letters(int(rng.integers(0, 300)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [passages[int(rng.integers(0, 5))], letters(int(rng.integers(0, 120)))]
        rows.append((i, "".join(parts)))
    near = list(rows[3][1] + letters(500))
    rows += [(60, "".join(near))]
    near[len(near) // 2] = "#"
    rows += [(61, "".join(near)), (62, "a" * 700), (63, "ab" * 300 + letters(50)), (64, "a" * 90), (65, None), (66, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert removed(substring_dedup.remove_repeats(docs)) == removal_rows([(i, (t or "").encode()) for i, t in rows], 100)
    spread = substring_dedup.remove_repeats(docs, group=1)  # every shared trigger taken apart string by string
    assert removed(spread) == removal_rows([(i, (t or "").encode()) for i, t in rows], 100)
    # rows with a missing id come last; a repeated row is a later one
    rows = [(1, passages[4]), (2, passages[4][:250] + "x" * 30), (2, passages[4][:250] + "x" * 30), (None, passages[4] + "tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(substring_dedup.remove_repeats(docs)) == removal_rows([(i, t.encode()) for i, t in rows], 100)
    assert substring_dedup.remove_repeats(odd).count() == len(odd_rows())
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_crowded_triggers_are_cut_into_few_pieces(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    common, ends = word(180), [word(3) for _ in range(6)]
    rows = [(i, word(150) + ends[i % 6] + common + ends[i % 5] + word(150)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cut, whole, finer = [], [], substring_dedup._finer

    def spy(bodies, length, width):
        out = finer(bodies, length, width)
        cut.append(out.count())
        whole.append(bodies.select(F.sum(F.length("body") - length + 1)).first()[0])
        return out

    monkeypatch.setattr(substring_dedup, "_finer", spy)
    want = removal_rows([(i, t.encode()) for i, t in rows], 100)
    assert removed(substring_dedup.remove_repeats(docs, group=20)) == want
    assert 0 < cut[0] < whole[0] / 5
    assert removed(substring_dedup.remove_repeats(docs, group=3)) == want
    assert len(cut) > 3


@needs_tables
def test_remove_repeats_table(spark, small):
    rows = sorted((r.doc_id, r.text) for r in small.collect())
    assert removed(substring_dedup.remove_repeats(small)) == removal_rows([(i, t.encode()) for i, t in rows], 100)


# --- quality rules


def counts_brute(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if spans[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


@given(st.text(alphabet="ab \n\t|é \x1c#", max_size=200))
@settings(max_examples=200, deadline=None)
def test_text_counts(text):
    assert quality_rules.text_counts(text) == counts_brute(text)


def test_judged(spark, odd, empty):
    got = quality_rules.judged(odd).collect()
    want = Counter()
    for r in odd_rows():
        c = counts_brute(r[1])
        want[(r[0], *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert Counter((r.doc_id, *[r[c] for c in quality_rules.COUNTS], r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.judged(empty).count() == 0


def test_outliers_against_numpy(spark):
    """Same verdicts as plain numpy C-steps on one group, and planted outliers go."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoin"), rng.integers(2, 8))) for _ in range(400)]
    rows = []
    for i in range(300):
        picked = rng.choice(words, rng.integers(60, 200)).tolist()
        if i % 20 == 0:
            picked = [w + "$$$ |" for w in picked]
        rows.append((i, " ".join(picked), "en", "s"))
    got = {r.doc_id: r.kept for r in quality_rules.judged(documents(spark, rows)).collect()}
    assert {i for i, kept in got.items() if not kept} == set(range(0, 300, 20))
    c = np.array([counts_brute(r[1]) for r in rows], dtype=float)
    x = np.stack([np.log(c[:, 1] / c[:, 0]), np.log1p(100 * c[:, 2] / c[:, 0]), np.log1p(c[:, 3]), np.log1p(100 * c[:, 4] / c[:, 0])], 1)
    floor = np.diag(np.square(quality_rules.FLOOR))
    mu = np.median(x, axis=0)
    inv = np.linalg.inv(np.diag((1.4826 * np.median(np.abs(x - mu), axis=0)) ** 2) + floor)
    for _ in range(quality_rules.STEPS):
        d = np.einsum("ni,ij,nj->n", x - mu, inv, x - mu)
        near = x[d <= np.sort(d)[int(np.ceil(0.75 * len(d))) - 1]]
        mu = near.mean(axis=0)
        inv = np.linalg.inv(quality_rules.CONSISTENCY * np.cov(near.T, bias=True) + floor)
    d = np.einsum("ni,ij,nj->n", x - mu, inv, x - mu)
    assert [bool(v) for v in d <= quality_rules.CUT] == [got[i] for i in range(300)]


def test_drop_rejected_keeps_columns(spark, odd, empty):
    from pyspark.sql import functions as F

    clash = odd.withColumn("kept", F.lit("k")).withColumn("_q", F.lit(1)).withColumn("distance", F.lit("d"))
    out = quality_rules.drop_rejected(clash)
    assert out.columns == clash.columns
    assert all(r["kept"] == "k" and r["distance"] == "d" for r in out.collect())
    assert quality_rules.drop_rejected(empty).count() == 0


# --- tokens and packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary.default_path())


SNIPPETS = st.sampled_from(["<|endoftext|>", "don't", "İ", "́", "é", "1234", " ", "\x1c", " ", "한글", "가", "...", "ß", "Σ"])


@given(st.lists(st.one_of(st.text(max_size=20), SNIPPETS), max_size=15).map("".join))
@settings(max_examples=300, deadline=None)
def test_chunks_equal_whole_text(text):
    from tokenizers import Tokenizer

    text = text.encode("utf-8", "ignore").decode()
    whole = Tokenizer.from_file(vocabulary.default_path()) if not hasattr(test_chunks_equal_whole_text, "t") else test_chunks_equal_whole_text.t
    test_chunks_equal_whole_text.t = whole
    vocab = getattr(test_chunks_equal_whole_text, "v", None) or vocabulary.Vocabulary(vocabulary.default_path())
    test_chunks_equal_whole_text.v = vocab
    got = np.frombuffer(b"".join(vocab.chunk_ids(text.encode().split())), dtype="<u4").tolist()
    assert got == whole.encode(text, add_special_tokens=False).ids


def test_token_prefixes(spark, odd, empty, tokenizer):
    from pyspark.sql import functions as F

    stored = token_counts.token_prefixes(odd)
    got = stored.select("doc_id", "n_bytes", token_counts.total_tokens().alias("n"), "prefix_bytes", "prefix_tokens").collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows())
    assert Counter((r.doc_id, r.n_bytes, r.n) for r in got) == want
    one = next(r for r in got if r.doc_id == 10)
    raw = ("été déjà " * 40).encode()
    for end, n in list(zip(one.prefix_bytes, one.prefix_tokens))[:12]:
        assert n == len(tokenizer.encode(raw[:end].decode(), add_special_tokens=False).ids)
    cut = stored.filter("doc_id = 10").select(token_counts.bytes_within(F.lit(5)).alias("b"), token_counts.tokens_up_to(F.lit(6)).alias("t")).first()
    fits = [(e, n) for e, n in zip(one.prefix_bytes, one.prefix_tokens) if n <= 5]
    assert cut.b == fits[-1][0] and cut.t == one.prefix_tokens[0]
    assert token_counts.token_prefixes(empty).count() == 0


def cost_brute(ends, costs, length):
    best = {0: 0}
    spots = list(zip([0, *ends], [0, *costs]))
    for j in range(1, len(spots)):
        q, c = spots[j]
        best[j] = min(best[i] + length - (q - spots[i][0]) + c for i in range(j) if 0 < q - spots[i][0] <= length)
    return best[len(spots) - 1]


@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from([0, 4])), min_size=1, max_size=25))
@settings(max_examples=200, deadline=None)
def test_cuts_are_cheapest(steps):
    ends = np.cumsum([s for s, _ in steps]).tolist()
    costs = [c for _, c in steps]
    length = 32
    cuts = packing.cuts_of(ends, costs, length)
    assert cuts[-1] == ends[-1] and all(0 < b - a <= length for a, b in zip([0, *cuts], cuts))
    price = dict(zip(ends, costs))
    total, at = 0, 0
    for cut in cuts:
        size = cut - at
        total += 0 if cut not in price or (size.bit_count() == 1 and cut != at + length) else length - size
        total += price.get(cut, packing.TOKEN_COST)
        at = cut
    assert total <= cost_brute(ends, costs, length)


def test_long_sentence_is_cut():
    cuts = packing.cuts_of([5, 5005], [0, 0], 2048)
    assert cuts[-1] == 5005 and all(0 < b - a <= 2048 for a, b in zip([0, *cuts], cuts))


def check_packing(rows, texts, tokenizer):
    """Each id in one piece, sequences gapless and within the length; texts: Counter of (id, text)."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    padding = tokens = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.LENGTH
        tokens += at
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    for (i, text), n in texts.items():
        if n > 1 or sum(k[0] == i for k in texts) > 1:
            continue
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    return padding, tokens


def test_pack_odd(spark, odd, empty, tokenizer):
    from tamiz.llm.queries import packing_digest

    rows = packing_digest(packing.pack(odd)).collect()
    check_packing(rows, Counter((r[0], r[1]) for r in odd_rows()), tokenizer)
    total = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in odd_rows())
    assert sum(r.length for r in rows) == total
    assert packing.pack(empty).count() == 0


@needs_tables
def test_pack_table(spark, small, tokenizer):
    rows = entry.queries()["op2_packing"](spark, SF).collect()
    padding, tokens = check_packing(rows, Counter((r.doc_id, r.text) for r in small.collect()), tokenizer)
    assert padding < 0.02 * tokens


# --- language


@needs_tables
def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents")
    got = langid.learned_languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark, odd, empty):
    got = langid.learned_languages(odd).collect()
    assert len(got) == len(odd_rows())
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 9)} == {"und"}
    assert {r.lang_pred for r in got} <= {"en", "fr", "de", "und"}
    assert langid.learned_languages(empty).count() == 0


def test_tables_equal_network():
    net = langid.ByteNet(["a", "b", "c"])
    x = np.random.default_rng(1).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    pooled = []
    for k, filters, bias in zip(langid.WIDTHS, net.filters, net.bias):
        span = np.stack([net.embed[x[:, j : j + k]].reshape(5, -1) for j in range(langid.WINDOW - k + 1)], axis=1)
        pooled.append((span @ filters + bias).max(axis=1))
    want = langid._softmax(np.maximum(np.concatenate(pooled, 1), 0) @ net.out + net.out_bias)
    assert np.allclose(langid.Scorer(net).probabilities(x), want, atol=1e-5)


# --- weak labels


def test_estimate_finds_the_better_labeller():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.6
    right = [0.95, 0.9, 0.55, 0.8, 0.8, 0.8, 0.7, 0.6]
    cast = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 for p in right], axis=1)
    cast[rng.random(cast.shape) < 0.2] = weak_quality.NONE
    patterns, inverse, counts = np.unique(cast @ 3 ** np.arange(8), return_inverse=True, return_counts=True)
    posterior, rates = weak_quality.estimate(patterns, counts)
    accuracy = rates[1, :, weak_quality.GOOD] / (rates[1, :, weak_quality.GOOD] + rates[1, :, weak_quality.BAD])
    assert np.allclose(accuracy, right, atol=0.06)
    assert np.mean((posterior[inverse] > 0.5) == truth) > 0.95


@needs_tables
def test_weak_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op1_weak_quality"](spark, sf).join(read(spark, sf, "labels"), "doc_id").filter("quality is not null").collect()
    good = np.array([r.good for r in got])
    label = np.array([r.quality == 1 for r in got])
    assert np.mean(good == label) > 0.9


def test_weak_quality_cases(spark, odd, empty):
    got = weak_quality.score_quality(odd).collect()
    assert len(got) == len(odd_rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.score == r.posterior for r in got if r.doc_id in (3, 4, 5))
    assert weak_quality.score_quality(empty).count() == 0


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [
        (5, "http://a", big), (3, "http://b", big), (3, "http://b", big), (None, None, big), (9, "http://c", "x" * 100), (8, None, "x" * 100),
        (1, "http://d", "x" * 99), (2, "http://e", "x" * 99), (4, "a\r\nb: c", None), (6, "u", ""), (None, "u", "only " * 30),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    want = Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same, default=None)
        again = len(body) >= 100 and first is not None and (i is None or i > first)
        want[(i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=1000)
    chunks = warc.read_chunks(spark, str(tmp_path / "w")).filter("page_id = 3 AND record_type = 'response'").collect()
    assert all(r.chunk_bytes <= 1000 for r in chunks)
    last = [r for r in chunks if r.is_last]
    assert len(last) == 2 and all(r.sha256_so_far == hashlib.sha256(big.encode()).hexdigest() for r in last)
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- mixing


def targets_brute(sizes):
    """Targets by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def check_mix(rows, texts):
    size = {}
    for s, t in texts:
        size[s] = size.get(s, 0) + len(WORDS.findall(t or ""))
    want = targets_brute(size)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        taken[r.source] += r.taken
    return {s: (taken[s], want[s]) for s in want}


@needs_tables
def test_mix_table(spark, small):
    rows = mixing.mix(small).collect()
    assert len(rows) == small.count()
    for got, want in check_mix(rows, [(r.source, r.text) for r in small.collect()]).values():
        assert abs(got - want) <= 0.02 * want + 64
    again = mixing.mix(small).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_odd(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], len(WORDS.findall(r[1] or ""))) for r in odd_rows())
    check_mix(rows, [(r[3], r[1]) for r in odd_rows()])
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() > 0
    assert mixing.mixed_documents(empty).count() == 0


@given(st.dictionaries(st.one_of(st.none(), st.text("abcé", max_size=3)), st.integers(0, 50), min_size=1, max_size=7))
@settings(max_examples=15, deadline=None)
def test_targets(spark, sizes):
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = targets_brute(sizes)
    assert {r.source: pytest.approx(r.target, abs=1e-6) for r in rows} == want


# --- pipeline


@needs_tables
def test_pipeline(spark, small, tokenizer):
    import corpus_pipeline

    docs = small
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    results = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        results[name] = docs.collect()
        assert docs.columns == small.columns
    judged = {r.doc_id for r in quality_rules.judged(small).collect() if r.kept}
    assert {r.doc_id for r in results["quality_rules"]} == judged
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in results["exact_dedup"]]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in results["quality_rules"]})
    roots = link_brute([print_brute(r.text) for r in results["exact_dedup"]])
    assert len(results["simhash_near_dedup"]) == len(set(roots.values()))
    mixed = Counter(r.doc_id for r in results["mixing"])
    assert set(mixed) <= {r.doc_id for r in results["simhash_near_dedup"]} and max(mixed.values()) <= 3
    rows = corpus_pipeline.run(spark, SF).collect()
    words = sum(r.length for r in rows)
    assert words == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in results["mixing"])
    assert pd.DataFrame(rows).shape[1] == 7
