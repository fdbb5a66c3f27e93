"""Rare words met lately are not merged again."""

from snarewatch.llm import bpe


class Counted:
    """A vocabulary that counts what it merges."""

    special: dict = {}

    def __init__(self):
        self.asked = 0

    def merge(self, word):
        self.asked += 1
        return (len(word),)


def test_a_quarter_of_a_million_words_are_merged_once():
    vocabulary = Counted()
    encoder = bpe.Encoder(vocabulary, None)
    letters = "abcdefghij"
    words = ["x" + "".join(letters[int(d)] for d in str(i)) for i in range(250_000)]
    text = "a " + " ".join(words)
    first = encoder.encode(text)
    asked = vocabulary.asked
    assert encoder.encode(text) == first and vocabulary.asked == asked
    assert len(encoder.lettered.new) + len(encoder.lettered.old) <= 2 * bpe.MEMO
