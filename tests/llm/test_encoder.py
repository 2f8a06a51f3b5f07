"""What a Python worker keeps from task to task."""

import public_tokenizers
from trailmill.llm import tokenfile


def test_words_met_before_are_found_without_a_pass_over_the_cache():
    class Watched(dict):
        def keys(self):
            raise AssertionError("a pass over all kept words")

    encoder = tokenfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.spaced = Watched()
    texts = ["one two three", "one  two", " two three ", "two \n three", "two\nthree one", "", None, "three \u3000 one", "one"]
    for _ in range(2):
        got = [x.tolist() for x in encoder.encode(texts)]
        assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


class Counted:
    """The tokenizer, counting the characters that it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.characters = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.characters += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_a_word_is_encoded_once_whatever_ends_it_or_follows_it():
    encoder = tokenfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    library = encoder.tokenizer
    encoder.tokenizer = Counted(library)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}zé" for i in range(100)]
    # every word with every end, and before every tenth word's line
    texts = [" ".join(w + end for w in words[i:] + words[:i]) + f"{end}\n{words[i]}{end}" for i in range(0, 100, 10) for end in ("", ".", ",", "!!", "):", ";")]
    for half in (texts[:7], texts[7:]):
        assert [x.tolist() for x in encoder.encode(half)] == [library.encode(t, add_special_tokens=False).ids for t in half]
    # each word after a space, some after a line feed, ends; each word with each end would be over 3,000
    assert encoder.tokenizer.characters < 1000


def test_ids_are_the_librarys_at_runs_of_white_space():
    encoder = tokenfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    runs = ["", " ", "\n", "  ", "\n\n", " \n", "\n ", "\n\n\n", "   ", "\t", "\t\n", "\r\n", "\r\n\r\n", "\n\t", " \t ", "　", "  ", "\xa0 ", "\x85\n", "\x1c"]
    texts = [a + x + b + y + a for a in runs for b in runs for x, y in (("one", "two"), ("end.", "'s,"), ("7!", "é?!"), ("漢。", "..."))]
    texts += [*runs, None, "a<|endoftext|> b", "\n<|endoftext|>", "it's.", "x'.", "²;", "×.", "ª,", "word........................"]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size in (1, 7, len(texts)):
        got = [x.tolist() for i in range(0, len(texts), size) for x in encoder.encode(texts[i : i + size])]
        assert got == want
