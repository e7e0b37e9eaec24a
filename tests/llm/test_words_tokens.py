import numpy as np
import pyarrow as pa

from memloom.llm import tokens, words


def test_words_of_sliced_arrays():
    texts = ["x", "Ab C", None, "", " D\x0be ", "É a\x1cb", "A B"]
    for lower in (False, True):
        w = words.split(pa.array(texts).slice(1), lower=lower)
        want = [((t or "").encode().lower() if lower else (t or "").encode()).split() for t in texts[1:]]
        names = w.distinct.to_pylist()
        assert [[names[c] for c in w.codes[a:b]] for a, b in zip(w.offsets, w.offsets[1:])] == want


def test_chunks_cover_every_row_once():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 9, 30, 1, 1)] + [None]})
    parts = list(words.chunks(batch, "text", 10))
    assert [p.num_rows for p in parts] == [2, 1, 1, 3]
    assert sum(p.num_rows for p in parts) == batch.num_rows
    assert list(words.chunks(batch.slice(0, 0), "text")) == []


def test_windows_depend_on_order_and_stay_in_texts():
    h = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
    w = words.windows(h, 3, 1)
    assert w[0] == w[3] and len({*w.tolist()}) == 5
    at, row = words.starts(np.array([0, 4, 4, 8]), 3)
    assert at.tolist() == [0, 1, 4, 5] and row.tolist() == [0, 0, 2, 2]


def test_ids_are_those_of_whole_texts(path, texts):
    odd = ["it's, we'll. É, é. H̱x <|endoftext|>. a<|startoftext|>,b 12,3. !,. ...", None, "", "ΣΑΣ. İ,  x\x1cy z", "don't,.a", "a\r\nb\tc'S.", "H̱x, E. É. aB. A", "Foo.Bar, baz.\x0b", "<|ENDOFTEXT|>"]
    every = odd + [texts[k] for k in sorted(texts)]
    encoder = tokens.WordEncoder(path, cache_words=3000)  # small: it starts anew again and again
    for start in range(0, len(every), 37):
        part = every[start : start + 37]
        ids, at = encoder.encode(pa.array(part, pa.string()))
        want = [x.ids + [1] for x in encoder.tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
