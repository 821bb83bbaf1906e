"""The operators' parts in plain Python: matrices, distances, hashes, scores."""

import random
import re

import numpy as np
import pytest

from inkvane.llm import decontaminate, jaccard, quality, substrings, urls, vectors, wavelet


@pytest.mark.parametrize(("n", "top"), [(0, 5), (1, 1), (1000, 1), (5000, 7), (20000, 3000), (1500, 49407)])
def test_wavelet_matrix(n, top):
    rng = np.random.default_rng(n)
    x = rng.integers(0, top, n).astype(np.uint32)
    docs, lengths, m = wavelet.open_shard(wavelet.pack_shard([None, 3], [n, 0], x))
    assert docs == [None, 3] and list(lengths) == [n, 0] and (m.decode() == x).all()
    for i in rng.integers(0, n, 40) if n else []:
        assert m.access(int(i)) == x[i]
    for v in (0, 1, top - 1, top + 5):
        assert m.occurrences(v) == np.flatnonzero(x == v).tolist() and m.count(v, n // 2) == (x[: n // 2] == v).sum()
    with pytest.raises(IndexError):
        m.access(n)
    with pytest.raises(ValueError):
        wavelet.open_shard(b"other")


def test_words_encode_like_the_whole_text():
    from tokenizers import Tokenizer

    path = wavelet.tokenizer_path()
    tokenizer, words = Tokenizer.from_file(path), wavelet.WordIds(path)
    rng = random.Random(1)
    letters = "aAzßÀÿ÷×ñ²½'sStTreLL0 9\t\n\x0b.,!<|>endoftext\u0301\u00a0\u2003\x85\x1cİΣσς漢🙂µªÅ\u212b"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["<|endoftext|> x<|startoftext|>y", "I'll don't 've'd", ""]
    for t in texts:
        want = np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert b"".join(map(words.__getitem__, t.encode().split())) == want, t


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        got, want = decontaminate.myers(decontaminate.masks(p), len(p), t, len(p)), edit_distance_in(p, t)
        # an empty stretch costs the whole pattern, which the search does not report
        assert (got[0] if got else len(p)) == want or want == len(p)


def test_pieces_survive_edits():
    rng = random.Random(3)
    item = "".join(rng.choice("abcdefghij ") for _ in range(200))
    item = decontaminate.normal(item)
    k = decontaminate.budget(len(item))
    assert k > 3 and "".join(p for _, p in decontaminate.pieces(item, k)) == item
    matcher = decontaminate.Matcher([(7, item), (8, ""), (9, "tiny")])
    for _ in range(50):
        t = list(item)
        for _ in range(k):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], ["x"], [t[i], "y"]])
        hits = matcher.hits("before " + "".join(t) + " after")
        assert [(n, d <= k) for n, d, _ in hits] == [(0, True)]
    assert matcher.hits("tinyer") == [] and [h[0] for h in matcher.hits("a tiny b")] == [1] and matcher.hits("") == []


def test_word_hashes_follow_words():
    for t in (b"", b" \t\n", b"a", b" ab  ab\x0bc\xc3\xa9 a\xc2\xa0b ", b"x" * 5000 + b" y"):
        words = t.split()
        h = substrings.word_hashes(t)
        assert len(h) == len(words)
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                assert (a == b) == (h[i, 0] == h[j, 0]) == (h[i, 1] == h[j, 1])


def test_runs_pack():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    checks, docs = rng.integers(0, 2**24, 500).astype(np.uint32), rng.integers(-5, 2**60, 500)
    got = substrings.unpack(substrings.pack(keys, checks, docs), 500)
    assert all((a == b).all() for a, b in zip(got, (keys, checks, docs), strict=True))


def test_covered():
    assert substrings.covered(np.array([0, 1, 0, 0], bool), 7, 3).tolist() == [False, True, True, True, False, False, False]


def test_minhash_estimates():
    a, b = (jaccard.shingles(" ".join(f"w{i}" for i in range(s, s + 1000)).encode()) for s in (0, 100))
    same = np.intersect1d(a, b).size
    got = (jaccard.signature(a) == jaccard.signature(b)).mean()
    assert abs(got - same / (len(a) + len(b) - same)) < 0.15
    assert len(jaccard.shingles(b"")) == 0 and len(jaccard.shingles(b"one two")) == 1
    assert jaccard.class_key(jaccard.shingles(b"one two")) != jaccard.class_key(jaccard.shingles(b"one two three"))


def test_pruning_keeps_what_is_likely():
    need = jaccard.least_matches(16, 0.8, 1e-6)
    assert 2 <= need <= 7 and jaccard.least_matches(100, 0.8, 1e-6) < 75
    a, b = jaccard.local_components(np.array([5, 3, 9, 7]), np.array([3, 1, 8, 8]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {1: 1, 3: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_pruning_between_blocks_without_survivors():
    reps, n, side = np.arange(300), np.full(300, 50), np.arange(300) // 150
    sig = np.random.default_rng(3).integers(0, 2**32, (300, jaccard.BANDS * jaccard.ROWS), dtype=np.uint32)
    assert jaccard.pruned_groups(reps, sig, n, side, 0.8, 1e-6).tolist() == list(range(300))
    sig[299] = sig[140]  # of the second slice of the left block
    assert jaccard.pruned_groups(reps, sig, n, side, 0.8, 1e-6).tolist() == [*range(299), 140]


def test_url_parts_and_model():
    model = urls.UrlModel.train(urls.labelled())
    assert model.score("", "") == 0 and urls.parts_of("X://A.b/C?d") == ("a.b", "/C") and urls.parts_of(None) == urls.parts_of("a/b") == ("", "")
    right = [(model.score(*urls.parts_of(u)) >= 0.5) == bool(y) for u, y in urls.labelled()]
    assert np.mean(right) > 0.95
    assert model.score("mega-casino-bonus.example", "/free/poker") >= 0.5 > model.score("www.library.example", "/en/77")


def test_classifier_separates_and_survives_little_data():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(5))
    rows = [(" ".join(word() for _ in range(80)).encode(), 1) for _ in range(60)] + [(" ".join(word().upper() + "!!" for _ in range(80)).encode(), 0) for _ in range(60)]
    model = quality.CompressionModel.fit(rows, 0.5)
    s = model.scores([t for t, _ in rows])
    assert ((s >= 0.5) == np.array([y for _, y in rows])).mean() > 0.95 and 0 <= model.scores([b""])[0] <= 1
    assert quality.CompressionModel.fit([(b"a", 1)], 1.0).scores([b"x"])[0] == 1
    tiny = quality.CompressionModel.fit([(b"good text", 1), (b"BAD!!", 0)], 0.5).scores([b"good text", b"BAD!!", b""])
    assert ((tiny >= 0) & (tiny <= 1)).all()


def test_groups_join():
    g = vectors.Groups(5)
    g.join(0, np.array([3]))
    g.join(4, np.array([3, 1]))
    assert len(set(g.label[[0, 1, 3, 4]])) == 1 and g.label[2] == 2


def test_url_pattern_matches_python():
    assert re.fullmatch(r"(?s).*?://([^/?#]*)([^?#]*).*", "x://a/b?c").groups() == ("a", "/b")
