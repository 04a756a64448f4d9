"""Scans, tags, features and models over text against brute force, exact round trips and held-out samples."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kindred.llm import language, media, packing, pii, secrets, tokenfile, vectors, words
from kindred.llm.tokens import Encoder, default_vocabulary, groups_by_size

ODD = ["", " ", "\n\t ", "a", "A b", "  lead and  double\n\nlines ", "é ü ß naïve Ünï", "日本 語 テキスト", "x" * 3000, "a b " * 2000, "a\tb\x0bc\x0cd\re", "don't I'll we've", "12 345,6 <|endoftext|> !!", "a\x1cb\xa0c d"]


def brute_words(text):
    return text.encode().lower().split()


def test_word_hashes_tell_words_apart_and_cut_texts():
    texts = [*ODD, *ODD[::-1]]
    raw, offsets = words.text_buffers(pa.array([*texts, None]))
    hashes, cuts = words.word_hashes(raw, offsets)
    by_word = {}
    for i, t in enumerate([*texts, ""]):
        want = brute_words(t)
        got = hashes[cuts[i] : cuts[i + 1]].tolist()
        assert len(got) == len(want)
        for w, h in zip(want, got, strict=True):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "be", "gamma-delta", "x" * 70], k=500))
    raw, offsets = words.text_buffers(pa.array([text, "tail"]))
    whole = words.word_hashes(raw, offsets)[0]
    monkeypatch.setattr(words, "CHUNK", 97)
    assert (words.word_hashes(raw, offsets)[0] == whole).all()


@pytest.mark.parametrize("width", [1, 2, 5])
def test_shingle_sets_match_brute_force(width):
    for text, got in zip(ODD, words.shingle_sets(pa.array(ODD), width), strict=True):
        w = brute_words(text)
        want = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        assert len(got) == len(want)


def brute_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_pii_patterns_match_brute_force():
    rng = random.Random(2)
    for _ in range(6000):
        text = "".join(rng.choice("ab1.@+-_ ()%45é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_pii(text), text
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8", "01.002.255.256", "a@b.c@d.e", "+1 (212) 555-0199 x", "0" * 5000, "@" * 500, "a" * 5000 + "@b.co"):
        assert pii.base_spans(text) == brute_pii(text), text


def test_tagger_gradients_and_held_out_samples():
    x, y = pii.labelled_samples(3, 24, 5)
    t = pii.Tagger(6)
    _, grads = t.loss_and_gradients(x, y)
    for name in ("out_f", "trans", "bias", "cell_b"):
        p, i = t.p[name], (0,) * t.p[name].ndim
        was = float(p[i])
        p[i] = was + 1e-2
        up = t.loss_and_gradients(x, y)[0]
        p[i] = was - 1e-2
        down = t.loss_and_gradients(x, y)[0]
        p[i] = was
        assert abs((up - down) / 2e-2 - grads[name][i]) < 2e-3, name
    tagger = pii.trained_tagger()
    x, y = pii.labelled_samples(400, 192, 999)
    found = tagger.viterbi(tagger.emissions(x))
    assert (found == y).mean() > 0.95

    def runs(tags, kind):
        edge = np.diff((tags == kind).astype(np.int8), axis=0, prepend=0, append=0)
        return {(lane, a, b) for lane in range(tags.shape[1]) for a, b in zip(np.flatnonzero(edge[:, lane] == 1).tolist(), np.flatnonzero(edge[:, lane] == -1).tolist(), strict=True)}

    for kind, least in zip((1, 2, 3, 4), (0.88, 0.92, 0.82, 0.88), strict=True):
        want, got = runs(y, kind), runs(found, kind)
        assert len(want) > 200 and len(want & got) >= least * len(want) and len(want & got) >= least * len(got), pii.KINDS[kind - 1]


def test_a_window_that_may_be_tagged_throughout_is_not_certified():
    tagger = pii.Tagger(2)
    tagger.p["trans"] = np.full((5, 5), -3.0, np.float32)
    tagger.p["trans"][0, 0] = 0.0
    tagger.p["trans"][1, 1] = -0.1
    emit = np.zeros((8, 5, 1), np.float32)
    emit[:, 1] = 0.05
    assert not tagger.surely_outside(emit)[0] or not tagger.viterbi(emit).any()
    emit[:, 1] = 0.095  # eight steps of 0.095 outweigh seven transitions of 0.1
    assert tagger.viterbi(emit).all() and not tagger.surely_outside(emit)[0]


def test_reconciled_spans_match_brute_force():
    rng = random.Random(11)
    span = lambda: (rng.choice(pii.KINDS), a := rng.randrange(60), a + rng.randint(1, 8))
    for _ in range(300):
        base, tagged = [span() for _ in range(rng.randint(0, 8))], [span() for _ in range(rng.randint(0, 8))]
        want = base + [t for t in tagged if all(t[2] <= s or t[1] >= e for _, s, e in base)]
        assert sorted(pii.reconcile(base, tagged)) == sorted(want)


def test_certified_windows_are_all_outside():
    tagger = pii.trained_tagger()
    x, _ = pii.labelled_samples(300, 96, 321)
    emit = tagger.emissions(x)
    sure = tagger.surely_outside(emit)
    assert not tagger.viterbi(emit)[:, sure].any()


def test_pii_adds_unlisted_forms_and_keeps_clean_text_alone():
    tagger = pii.trained_tagger()
    found = [all_ for _, all_ in pii.spans_of(["call 415-555-0123 today", "the plain words of a long and clean sentence, in 2024 it was 12:30.", None, ""], tagger)]
    assert found[0] == [("phone", 5, 17)]
    assert found[1:] == [[], [], []]


def test_pii_spans_do_not_depend_on_window_place():
    tagger = pii.trained_tagger()
    mail = "someone.else@mail7.example.com"
    for lead in (0, 100, 447, 480, 511, 900, 2000):
        text = ("word " * 1000)[:lead] + " " + mail + " " + "then " * 300
        (_, all_) = next(pii.spans_of([text], tagger))
        assert ("email", lead + 1, lead + 1 + len(mail)) in all_


def test_masking():
    assert pii.masked("a bb ccc", [("ip", 2, 4)]) == "a <IP> ccc"
    assert pii.masked("abcdef", [("card", 0, 4), ("phone", 2, 6)]) == "<CARD>"


def brute_secrets(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secret_patterns_match_brute_force():
    rng = random.Random(3)
    bits = ["password", "PassWD", "secret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEF012345", "0123456789abcdef" * 2, "abc.def", "x", "é", "ſecret", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert secrets.base_spans(text) == brute_secrets(text), text


def test_markov_ratio_parts_held_out_samples():
    ratio = secrets.trained_ratio()
    random_, ordinary = secrets.labelled_strings(1500, 777)
    assert (ratio.scores(random_) > ratio.threshold).mean() > 0.97
    assert (ratio.scores(ordinary) > ratio.threshold).mean() < 0.01
    _, all_ = secrets.spans_of("the key 9aF3kLmQ2zXcV7bN1pRtW0 was lost; see some_ordinary_identifier_name", ratio)
    assert [k for k, _, _ in all_] == ["markov"]


def test_keys_inside_longer_runs():
    ratio, rng = secrets.trained_ratio(), random.Random(5)
    path = "/projects/internal/documentation/downloads/release/latest/"
    letters = secrets.ALPHABET[:26]
    for alphabet in (letters, letters.upper(), letters + letters.upper(), letters + "0123456789"):
        keys = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(200)]
        assert sum(secrets.spans_of(f"see {k} now", ratio)[1] == [("markov", 4, 36)] for k in keys) >= 195, alphabet
    assert sum(bool(secrets.stretches(f"{path}{rng.randrange(10**16):016d}/index_page", ratio)) for _ in range(300)) <= 3
    key = lambda k, letters=secrets.ALPHABET[:62]: "".join(rng.choice(letters) for _ in range(k))
    around = [("", ""), (path, ""), (path, "/index_page_of_the_service"), ("MY_SERVICE_ACCOUNT_NAME=", ""), (path, path)]
    for k in (16, 24, 40):
        for before, after in around:
            found = 0
            for _ in range(100):
                own = key(k)
                spans = [(a, b) for kind, a, b in secrets.spans_of(f"see {before}{own}{after} now", ratio)[1] if kind == "markov"]
                found += any(a <= 4 + len(before) and b >= 4 + len(before) + k for a, b in spans)
            assert found >= (85 if k == 16 else 97), (k, before, after, found)
    one, two = key(32), key(32)
    spans = secrets.spans_of(f"{path}{one}{path}{two}{path}", ratio)[1]
    assert len(spans) == 2  # each with its key, and at most a word beside it
    for (_, a, b), at in zip(spans, (len(path), 2 * len(path) + 32), strict=True):
        assert at - 12 <= a <= at and at + 32 <= b <= at + 44
    hexa = "0123456789abcdef" * 2
    _, all_ = secrets.spans_of(f"{hexa}/{one}", ratio)
    assert all_[0] == ("hex", 0, 32) and all_[1][0] == "markov" and all_[1][1] <= 33 and all_[1][2] == 65
    _, all_ = secrets.spans_of(f"{one}/{hexa}-{two}", ratio)
    assert [s[0] for s in all_] == ["markov", "hex", "markov"]
    _, ordinary = secrets.labelled_strings(1500, 778)
    assert sum(bool(secrets.stretches(s, ratio)) for s in ordinary) <= 15
    assert secrets.spans_of(f"{path}2024-11-26/version_12/Release_Notes", ratio)[1] == []


@pytest.mark.parametrize("text", ["", "a", "word " * 115, "x" * 576, "y" * 577, "é" * 5000])
def test_media_round_trip(text):
    payload = media.pad_payload(text.encode())
    assert len(payload) % 576 == 0 and payload.startswith(text.encode())
    assert media.read_wav(media.write_wav(payload)) == payload
    mels, energy = media.log_mel(payload)
    tensors, start, end = media.from_tensors(media.to_tensors(mels))
    assert tensors.shape[1:] == (media.TENSOR_FRAMES, media.MELS) and np.allclose(tensors.reshape(-1, media.MELS)[: len(mels)], mels)
    assert (end > start).all() and len(energy) == len(mels)


def test_polyphase_equals_direct_filter_and_blocks():
    x = np.random.default_rng(1).standard_normal(4000).astype(np.float32)
    whole = media.resample(x, 0, 2400)
    assert np.allclose(whole[900:1800], media.resample(x, 900, 900), atol=1e-6)
    proto = np.ascontiguousarray(media._filters()[:, ::-1].T).reshape(-1)
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    n = 1200
    at = n * media.DOWN + (media.TAPS // 2 - 1) * media.UP
    direct = sum(proto[k] * up[at - k] for k in range(len(proto)) if 0 <= at - k < len(up))
    assert abs(direct - whole[n]) < 1e-3


def test_hysteresis_keeps_what_lies_between():
    energy = np.array([0, 0, 5, 2.5, 2.5, 5, 0, 2.5, 0, 0], float)
    assert media.segments(energy) == [(2, 6)]


def test_encoder_equals_the_library():
    encoder = Encoder.of()
    rng = random.Random(4)
    texts = [*ODD, None, *("".join(rng.choice("ab é  \n\t.,'s1\x1c\xa0-") for _ in range(rng.randint(1, 16))) for _ in range(2000))]
    for a, b in groups_by_size(texts, 500):
        ids, offsets = encoder.encode(texts[a:b], 0)
        for i, t in enumerate(texts[a:b]):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*encoder._full.encode(t or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("n", [1, 2, 127, 128, 257, 9000, 40_001])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.3, n).clip(0, 65535), rng.integers(0, 65536, n), np.zeros(n, int), np.arange(n) % 7 + 50000, np.full(n, 65535)):
        words, counts = tokenfile.encode_block(ids.astype(np.uint32))
        assert (tokenfile.decode_block(words, counts, n) == ids).all()


def test_range_coder_over_blocks(monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 1000)
    ids = np.random.default_rng(3).integers(0, 300, 3500).astype(np.uint32)
    seg = tokenfile.write_segment([5], np.array([3500]), ids) + tokenfile.END_MARK
    [(names, counts, got)] = tokenfile.read_segments(seg)
    assert names == [5] and counts.tolist() == [3500] and (got == ids).all()


def test_range_coder_beats_deflate_on_documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")["text"].to_pylist()
    encoder = Encoder.of()
    ids = np.concatenate([encoder.encode(texts[a:b], 0)[0] for a, b in groups_by_size(texts)])
    words, counts = tokenfile.encode_block(ids)
    assert (tokenfile.decode_block(words, counts, len(ids)) == ids).all()
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    entropy = -(share * np.log2(share)).sum() / 8
    deflated = len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)
    assert 2 * (len(words) + len(counts)) / len(ids) < min(0.9 * deflated, entropy)


def test_segments_code_ids_by_their_place_among_those_used(monkeypatch):
    real, seen = tokenfile.encode_block, []
    monkeypatch.setattr(tokenfile, "encode_block", lambda ids, *most: seen.append((int(ids.max()), *most)) or real(ids, *most))
    ids = np.random.default_rng(6).choice(np.array([7, 50000, 65535], np.uint32), 4000)
    seg = tokenfile.write_segment([1], np.array([4000]), ids) + tokenfile.END_MARK
    assert seen == [(2, 3)]  # tables of three ids, not of 65,536
    assert [x[2].tolist() for x in tokenfile.read_segments(seg)] == [ids.tolist()]


def test_pieces_of_either_generation_are_not_encoded_again():
    encoder, calls = Encoder(default_vocabulary(), 1000), []
    add = encoder._add_word
    encoder._add_word = lambda word: calls.append(word) or add(word)
    words_ = ["".join(c) for c in itertools.islice(itertools.product("abcdefghij", repeat=4), 1500)]
    first = encoder.encode(["x " + " ".join(words_)])[0].tolist()
    for _ in range(3):  # each begins a new generation
        assert encoder.encode(["x " + " ".join(words_)])[0].tolist() == first
    assert len(calls) == 1500
    assert encoder.encode(["x " + "? ".join(words_[:50]) + "?"])[0].tolist() == encoder._full.encode("x " + "? ".join(words_[:50]) + "?", add_special_tokens=False).ids


def test_damaged_segments_are_noticed():
    seg = tokenfile.write_segment([1, None], np.array([3, 2]), np.array([1, 2, 0, 9, 0], np.uint32)) + tokenfile.END_MARK
    assert [(a, b.tolist(), c.tolist()) for a, b, c in tokenfile.read_segments(seg)] == [([1, None], [3, 2], [1, 2, 0, 9, 0])]
    bad = bytearray(seg)
    bad[-12] ^= 1
    with pytest.raises(ValueError):
        list(tokenfile.read_segments(bytes(bad)))


def test_best_fit_decreasing_and_bound():
    rng = np.random.default_rng(5)
    for _ in range(200):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, made = packing.best_fit_decreasing(lengths, 100)
        assert np.bincount(bins, weights=lengths).max() <= 100 and bins.max() + 1 == made
        for b in range(made):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert (offsets[own] == np.concatenate([[0], np.cumsum(lengths[own])[:-1]])).all()
        low = packing.lower_bound(lengths, 100)
        assert -(-int(lengths.sum()) // 100) <= low <= made
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3


def test_pieces():
    assert packing.cut_pieces(5, 10) == [(0, 5)] and packing.cut_pieces(10, 10) == [(0, 10)]
    assert packing.cut_pieces(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_language_model_on_held_out_text_and_letterless_text():
    rng = random.Random(6)
    vocab = {"aa": "the of and to in is that".split(), "bb": "der die und das nicht ein mit".split()}
    make = lambda k: " ".join(rng.choices(vocab[k], k=40))
    samples = [(k, *language.subword_counts(np.frombuffer(make(k).encode(), np.uint8))) for k in vocab for _ in range(80)]
    model = language.fit(samples)
    texts = [make("aa"), make("bb"), None, "", "123 !?", make("aa").upper(), "²½ 12", "\u00b2" * 5000, "12 " * 5000 + "\u00e9"]
    names, score = model.predict(pa.array(texts))
    assert names[:8] == ["aa", "bb", "und", "und", "und", "aa", "und", "und"] and names[8] != "und"
    assert ((score >= 0) & (score <= 1)).all() and score[0] > 0.8
    assert language.fit([]).predict(pa.array(["words"]))[0] == ["und"]


def test_language_of_long_texts_does_not_depend_on_blocks(monkeypatch):
    rng = random.Random(7)
    text = " ".join(rng.choices("the of and to in is that über naïve".split(), k=2000)).encode()
    raw = np.frombuffer(text, np.uint8)
    whole = np.bincount(language.subwords(raw)[0], minlength=language.BUCKETS)
    model = language.Model(["x", "y"], np.random.default_rng(1).standard_normal((language.BUCKETS, 2)), None, np.zeros(2), 1.0, 0.0)
    before = model.predict(pa.array([text.decode(), "short one"]))
    monkeypatch.setattr(language, "BLOCK", 101)
    buckets, counts = language.subword_counts(raw)
    assert (whole[buckets] == counts).all() and whole.sum() == counts.sum()
    after = model.predict(pa.array([text.decode(), "short one"]))
    assert before[0] == after[0] and np.allclose(before[1], after[1])


def test_language_of_one_long_text_and_of_many_languages():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = {f"l{k:03d}": ["".join(rng.choices(letters, k=6)) for _ in range(6)] for k in range(600)}
    make = lambda k, n: " ".join(rng.choices(vocab[k], k=n))
    model = language.fit([(k, *language.subword_counts(np.frombuffer(make(k, 30).encode(), np.uint8))) for k in vocab for _ in range(4)], epochs=12)
    assert len(model.labels) == 600 and model.weights is not None
    names, _ = model.predict(pa.array([make(k, 30) for k in vocab] + [make("l007", 200_000)]))
    assert sum(a == b for a, b in zip(names, vocab, strict=False)) >= 450 and names[-1] == "l007"


def test_forest_recall_on_64_dimensions():
    """Pairs at the threshold of single and of clustered vectors meet in a leaf of the default forest."""
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, other = unit(rng.standard_normal((4000, 64))), rng.standard_normal((4000, 64))
    other = unit(other - (other * x).sum(axis=1, keepdims=True) * x)
    single = np.concatenate([x, 0.98 * x + np.sqrt(1 - 0.98**2) * other])
    clustered = unit(rng.standard_normal((20, 64))[rng.integers(0, 20, 8000)] + rng.standard_normal((8000, 64)) * 0.14)
    a, b = np.nonzero(np.triu(clustered[:1500] @ clustered[:1500].T >= 0.98, 1))
    for rows, pairs in ((single, np.stack([np.arange(2000), np.arange(2000) + 4000], 1)), (clustered, np.stack([a, b], 1)[:4000])):
        forest = vectors.Forest({(0, 64): rows}, 0.98, vectors.TREES, vectors.LEAF_ROWS)
        row, leaf = forest.leaves_of((0, 64), rows)
        of = np.zeros((len(rows), int(leaf.max()) + 1), bool)
        of[row, leaf] = True
        assert len(pairs) >= 1000 and (of[pairs[:, 0]] & of[pairs[:, 1]]).any(axis=1).mean() >= 0.99
