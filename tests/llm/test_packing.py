import random
import zlib

import numpy as np
import pytest
from codeloom.llm.packing import BestFit, pack, token_source
from codeloom.llm.queries import tokenizer_path
from helpers import ODD, docs

tokenizers = pytest.importorskip("tokenizers")


def brute_ids(text):
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, out, length):
    by_row = sorted((-1 if i is None else i, p, s, n, c) for i, t in rows for p, s, n, c in pieces(t, length))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == by_row
    bins = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert all(n <= length for n in bins.values())
    return bins


def pieces(text, length):
    ids = np.array(brute_ids(text), "<u4")
    return [(k, s, len(ids[s : s + length]), zlib.crc32(ids[s : s + length].tobytes())) for k, s in enumerate(range(0, len(ids), length))]


def test_odd_rows(spark):
    bins = check(ODD, pack(docs(spark, ODD, extra=True), tokenizer_path()).collect(), 2048)
    assert bins


def test_empty_table(spark):
    assert pack(docs(spark, []), tokenizer_path()).count() == 0


def test_open_bins_are_packed_again_across_tasks(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma,", "Delta."], k=r.randint(1, 60)))) for i in range(400)]
    out = pack(docs(spark, rows).repartition(20), tokenizer_path(), length=64, open_bins=4).collect()
    bins = check(rows, out, 64)
    total = sum(bins.values())
    assert len(bins) <= 1.1 * -(-total // 64)


def test_best_fit_takes_the_fullest_bin_that_fits():
    fit = BestFit(10, 2)
    assert fit.put(6) == (0, 0) and fit.put(5) == (1, 0)
    assert fit.put(4) == (0, 6)  # exactly full: leaves the open bins
    assert fit.put(8) == (2, 0) and fit.open() == {1: 5, 2: 2}
    assert fit.put(9) == (3, 0) and fit.open() == {1: 5, 3: 1}  # the fullest, with 2 free, was closed


def test_ids_from_cached_parts_equal_those_of_the_tokenizer():
    r = random.Random(4)
    letters = list("aBs'll\t\n\r\x0b\x0c\x85\xa0  éÉßÀÿ×12!?@#-_​\x1b\x1f東.,<>|(){}[]^`~$%&*+/:;=\"\\ ") + ["'s", "'LL", "word", "<|endoftext|>", "İ", "ﬁ"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 30))) for _ in range(3000)]
    ids = token_source(tokenizer_path())()(texts)
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist()[:-1] for x in ids] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_a_word_is_tokenised_once_for_all_marks_around_it():
    import sys

    import public_tokenizers
    from codeloom.llm.packing import END, token_source

    path = public_tokenizers.path("word_bpe_49k.json")
    many = token_source(path)()
    kept = sys.modules["_codeloom_tokens"]
    plain, seen = kept.tokenizer, []

    class Counting:
        def encode(self, text, **options):
            seen.extend(text.split(" "))
            return plain.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            return plain.encode_batch_fast(texts, **options)

    kept.tokenizer = Counting()
    try:
        text = "zorbleflux zorbleflux, (zorbleflux) zorbleflux!? [zorbleflux"
        found = many([text])[0]
    finally:
        kept.tokenizer = plain
    assert seen.count("zorbleflux") == 1 and not any("zorbleflux" in x and x != "zorbleflux" for x in seen)
    assert found == b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids) + END


def test_a_word_is_tokenised_once_in_upper_and_lower_case():
    import sys

    many = token_source(tokenizer_path())()
    kept = sys.modules["_codeloom_tokens"]
    plain, seen = kept.tokenizer, []

    class Counting:
        def encode(self, text, **options):
            seen.extend(text.split(" "))
            return plain.encode(text, **options)

    texts = ["Quorblezép quorblezép, QUORBLEZÉP!", "\u0130 Quorblezép \u03a3\u03a3 O\u03a3", "<|ENDOFTEXT|> Quorblezép <|endoftext|>", None]
    kept.tokenizer = Counting()
    try:
        found = many(texts[:1])
    finally:
        kept.tokenizer = plain
    assert [x.lower() for x in seen].count("quorblezép") == 1
    found += many(texts[1:])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [brute_ids(x) for x in texts]
