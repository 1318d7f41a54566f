"""Encoding against the tokenizers library."""

import hashlib
import random

from timelens.llm import bpe


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def samples():
    rng = random.Random(3)
    parts = ["the", "Th", "ing", " ", "  ", "\n", "'s", "'LL", "é", "É", "Ça", "ß", "Σ", "ΑΣ", "İ", "1", "23", "½", "Ⅷ", "!", "...", "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "</w>", "😀", "中文", "\x1c", "\x85", "\xa0", "​", "zz", "qu", "́", "a" * 40, "ﬁ", "ǅ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["", " ", "x" * 5000, "ab" * 3000]


def test_matches_library():
    tok, own = library(), bpe.WordBpe(bpe.vocabulary(bpe.default_path()))
    texts = samples()
    for text, enc, (ids, decoded) in zip(texts, tok.encode_batch(texts, add_special_tokens=False), own.encode_texts(texts), strict=True):
        assert ids == " ".join(map(str, enc.ids)), text
        assert decoded == tok.decode(enc.ids, skip_special_tokens=False), text
    assert own.decode(own.encode("hello world")) == tok.decode(tok.encode("hello world").ids)


def test_bounded_caches(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 5)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    tok, own = library(), bpe.WordBpe(bpe.vocabulary(bpe.default_path()))
    for text in samples()[:200]:
        assert own.encode(text) == tok.encode(text, add_special_tokens=False).ids


def test_special_strings_in_other_cases_are_plain_text():
    tok, own = library(), bpe.WordBpe(bpe.vocabulary(bpe.default_path()))
    for text in ("<|ENDOFTEXT|>", "a <|endoftext|> b <|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|><|startoftext|>"):
        assert own.encode(text) == tok.encode(text, add_special_tokens=False).ids
    assert own.encode("<|ENDOFTEXT|>") == [27, 347, 40786, 4160, 91, 285]


def test_rare_words_match_library():
    """Long words of few letters and of bytes outside ASCII reach deep merges."""
    rng = random.Random(11)
    tok, own = library(), bpe.WordBpe(bpe.vocabulary(bpe.default_path()))
    texts = [" ".join("".join(rng.choice("aeinrstlohé" if i % 2 else "thingoerüñ中.!'") for _ in range(rng.randint(1, 24))) for _ in range(40)) for i in range(600)]
    for text, enc, (ids, _) in zip(texts, tok.encode_batch(texts, add_special_tokens=False), own.encode_texts(texts), strict=True):
        assert ids == " ".join(map(str, enc.ids)), text


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "Some words", "x"), (2, None, "y"), (2, None, "y"), (None, "z", "z")], "doc_id long, text string, n_tokens string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = bpe.query(spark, str(tmp_path)).collect()
    ids = library().encode("Some words", add_special_tokens=False).ids
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 4 and got[1]["n_tokens"] == len(ids) and got[2]["n_tokens"] == 0
    assert got[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_every_code_point_matches_library():
    """Each alone, after a letter, before a digit, after a sign, and between letters."""
    tok, own = library(), bpe.WordBpe(bpe.vocabulary(bpe.default_path()))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{c} a{c} {c}1 !{c} a{c}b" for c in every[i : i + 200]) for i in range(0, len(every), 200)]
    wrong = []
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        for text, enc, (ids, decoded) in zip(part, tok.encode_batch(part, add_special_tokens=False), own.encode_texts(part), strict=True):
            if ids != " ".join(map(str, enc.ids)) or decoded != tok.decode(enc.ids, skip_special_tokens=False):
                wrong.append(hex(ord(text[0])))
    assert not wrong


def test_empty_table_and_a_very_long_text(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert bpe.query(spark, f"{tmp_path}/none").collect() == []
    text = "The thing's é 12 " * 200_000
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/long/documents.parquet")
    ids = library().encode(text, add_special_tokens=False).ids
    assert bpe.query(spark, f"{tmp_path}/long").first()["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
