"""What keeps the bit model of op7 cheap: one 32-bit number per bit, parts cut per document, frequent words found without a search."""
import numpy as np
import pyarrow as pa

from barwright.llm import lm_score


def test_what_a_bit_needs_is_one_number():
    code = lm_score.huffman(np.arange(1, 257))
    data = np.frombuffer(b"abc\0de\0", np.uint8)
    place = np.array([0, 1, 2, 3, 0, 1, 2], np.int32)
    order = np.array([4, 5, 6, 0, 1, 2, 3])
    ends, places, known, slots = lm_score.known_bits(code, data, place, 0, order)
    at = np.concatenate([np.arange(code.start[b], code.start[b] + code.size[b]) for b in data[order]])
    of = np.repeat(order, code.size[data[order]])
    assert (places == at).all() and (lm_score.bit_events(code, data, place, 0, order)[0] == np.diff(ends)).all()
    assert known.dtype == np.int32 and ends.tolist() == [0, *np.cumsum(code.size[data[order]])]
    assert (known >> lm_score.SLOT_BITS + 8 == code.bits[at]).all() and (known >> lm_score.SLOT_BITS & 255 == code.nodes[at]).all()
    for s, h in zip(slots, lm_score.contexts(data, place)):
        assert s.dtype == np.int32 and (s == (lm_score.slot_of(h)[of] ^ code.salt[at])).all()


def test_long_documents_and_single_ones_score_as_in_a_slice():
    texts = ["", "x", "the cat sat " * 60, "on the mat " * 900, "a", "the mat sat " * 7000]
    column = pa.array(texts, pa.string())
    code = lm_score.huffman(np.ones(256, np.int64))
    n = np.zeros((2, lm_score.CONTEXTS << lm_score.SLOT_BITS), np.int64)
    for b in lm_score.count_bits(iter([pa.record_batch([column], names=["text"])]), code):
        n[0][b.column(0).to_numpy()], n[1][b.column(0).to_numpy()] = b.column(1).to_numpy(), b.column(2).to_numpy()
    model = lm_score.fit_gates(code, n[0].reshape(lm_score.CONTEXTS, -1), n[1].reshape(lm_score.CONTEXTS, -1), column)
    assert np.allclose(model.bits_of(column), [model.bits_of(pa.array([t], pa.string()))[0] for t in texts], rtol=1e-6)


def test_of_words_in_one_place_the_most_frequent_is_found_at_once():
    keys = np.array([5, 5 + (1 << 20), 5 + (2 << 20)], np.uint64)
    known = lm_score.Known.of(keys, np.array([7, 90, 8]))
    assert known.keys[known.table[5]] == 5 + (1 << 20)
    assert known.count(np.append(keys, np.uint64(6))).tolist() == [7, 90, 8, -1]
