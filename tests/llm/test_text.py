import random

import numpy as np
import pyarrow as pa

from setscope.llm.text import WordTable, word_hashes


def test_table_gives_what_compute_gives_with_any_limit():
    rnd = random.Random(2)
    compute = lambda words: (np.array([len(w) for w in words]), np.array([[len(w), ord(w[0])] for w in words], float).reshape(-1, 2))
    for limit in (0, 400, 1500, 1 << 20):
        table = WordTable(compute, limit)
        for _ in range(30):
            words = [rnd.choice("abcé") + str(rnd.randrange(120)) for _ in range(rnd.randrange(1, 60))]
            rows, (length, pair) = table.lookup(pa.array(words))
            assert length[rows].tolist() == [len(w) for w in words]
            assert pair[rows].tolist() == [[len(w), ord(w[0])] for w in words]
        assert (np.diff(table.keys.astype(object)) > 0).all()
        assert limit or len(table.keys) <= 60


def test_hashes_tell_words_apart_and_do_not_depend_on_their_place():
    words = [f"w{i}" for i in range(5000)] + ["ab", "ba", "aab", "é", "", "a" * 300, "b" * 300]
    one, two = word_hashes(pa.array(words))
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words)
    turned = word_hashes(pa.array(["x", *words[::-1]])[1:])
    assert (turned[0][::-1] == one).all() and (turned[1][::-1] == two).all()
