"""The cut of chunks against the library's own, over every character that is taken as settled, and on random texts."""

import random

from treequarry.llm import tokens


def test_settled_characters():
    encoder = tokens.PreTokens("byte_bpe_50k.json", list, lambda parts: [i for p in parts for i in p])
    library = encoder.tokenizer
    for code in range(ord(tokens.SETTLED)):
        for text in (f"a{chr(code)}b c{chr(code)}", f"{chr(code)}{chr(code)}1 '{chr(code)}s", f"x {chr(code)} y\n{chr(code)}"):
            assert encoder.many([text]) == [library.encode(text, add_special_tokens=False).ids], repr(text)


def test_random_texts():
    rng = random.Random(6)
    alphabet = ["a", "B", "é", "ß", "1", "½", "'s", "'", "!", "#", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", " ", "\x1c", "日", "🙂", "ﬁ", "<|endoftext|>", "don't", "ͅ", "́"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(4000)] + [None, ""]
    encoder = tokens.PreTokens("byte_bpe_50k.json", list, lambda parts: [i for p in parts for i in p], limit=50)
    assert encoder.many(texts) == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_are_left_to_the_library():
    encoder = tokens.PreTokens("word_bpe_49k.json", list, lambda parts: [i for p in parts for i in p])
    texts = ["Hello World, it's 1 test", "  two   spaces ", "", None, "a\nb c\nd", "éÉ"]
    assert not encoder.exact and tokens.PreTokens("byte_bpe_50k.json", len, sum).exact
    assert encoder.many(texts) == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
