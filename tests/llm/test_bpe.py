import random

import pytest
from tokenizers import Tokenizer

from quarterloom.llm.bpe import DEFAULT_PATH, Encoder, Vocabulary, encode_corpus

TEXTS = [
    "", " ", "Hello world", "a" * 30_001, "ab" * 700, "<|endoftext|> is text", "naïve café 中文字 ไทย हिन्दी", "\x00\x01\r\n\t  x", "don't WE'LL 'tis",
    "1,234.56%", "🧑‍💼📈", "́combining", "   leading", "trailing   ", "​­�", "word " * 3000,
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(DEFAULT_PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_the_library(reference):
    rng = random.Random(4)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    texts = TEXTS + noise
    assert Encoder(Vocabulary()).encode(texts) == reference(texts)


def test_one_word_of_many_different_letters(reference):
    rng = random.Random(8)
    word = "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(3000))
    assert Encoder(Vocabulary()).encode([word]) == reference([word])


def test_frame(spark, reference):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(None, None, 1), (0, TEXTS[2], 2), (99, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = encode_corpus(df).collect()
    want = reference([t or "" for _, t, _ in rows])
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == sorted((repr(i), w) for (i, _, _), w in zip(rows, want))
    assert encode_corpus(df.limit(0)).count() == 0
