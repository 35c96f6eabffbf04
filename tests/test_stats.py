import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from framestride.errors import DatasetError
from framestride.functions import pixels
from framestride.functions.depth import Depth, dequantize, quantize
from framestride.operators import stats


def one(values, dtype):
    return stats.episode(np.array(values)[None], dtype)


def test_float32_goldens():
    s = one([0.0, 0.1], "float32")
    assert s.values["std"][0] == 0.05000000074505806
    assert s.values["q90"][0] == 0.09999600052833557
    assert one([0.0, 0.1], "float64").values["q90"][0] == 0.099996000099992


def test_pairwise_sums_cancel_as_numpy_does():
    s = one([1e8, -1e8, 1.0] * 43, "float32")
    assert s.values["mean"][0] == 0.0 and s.values["std"][0] == 81649656.0


def test_merge_goldens():
    a, b = one([0.0, 0.1], "float32"), one([1.0, 1.1], "float32")
    assert stats.merge_all([a, b]).values["std"][0] == 0.5024938447111051


def test_singletons_and_overflow():
    s = one([1e30], "float32")
    assert s.values["std"][0] == 0.0 and s.values["q50"][0] == s.values["mean"][0] == float(np.float32(1e30))
    assert not np.isfinite(one([1e30, 2e30], "float32").values["std"][0])
    for bad in (float("nan"), float("inf")):
        with pytest.raises(DatasetError, match="NaN or infinity"):
            one([0.0, bad], "float64")


def test_exact_integers():
    x = np.array([[2**63 + 5, 2**64 - 1, 2**63 + 7]], np.uint64)
    assert stats.episode(x, "uint64", x).exact == {"min": [2**63 + 5], "max": [2**64 - 1]}


@pytest.mark.parametrize("dtype", ["float32", "float64"])
@pytest.mark.parametrize("n", [1, 7, 8, 129, 2050])
@pytest.mark.parametrize("width", [1, 14, 65])
def test_dyadic_grid_against_plain_numpy(dtype, n, width):
    x = np.array([[((i + d) % 7 - 3) / 2 for i in range(n)] for d in range(width)])
    s = stats.episode(x, dtype)
    assert np.array_equal(s.values["min"], x.min(1)) and np.array_equal(s.values["max"], x.max(1))
    assert np.allclose(s.values["mean"], x.mean(1), atol=1e-6) and np.allclose(s.values["std"], x.std(1), atol=1e-6)
    if n > 1:
        assert np.allclose(s.values["q50"], np.quantile(x, 0.5, axis=1, method="inverted_cdf"), atol=(x.max() - x.min()) / 2500 + 1e-6)


@given(st.lists(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20), min_size=1, max_size=6))
def test_merges_agree_with_the_whole(parts):
    s = stats.merge_all([one(p, "float64") for p in parts])
    every = np.concatenate(parts)
    assert s.count == len(every) and s.values["min"][0] == every.min() and s.values["max"][0] == every.max()
    assert np.isclose(s.values["mean"][0], every.mean(), atol=1e-6) and np.isclose(s.values["std"][0], every.std(), atol=1e-2, rtol=1e-4)


def test_visual():
    rgb = np.array([[0, 51, 102], [255, 255, 255], [0, 0, 0]], np.uint8)
    s = stats.visual(rgb, False)
    assert s.values["max"].tolist() == [float(np.float32(102) / np.float32(255)), 1.0, 0.0]
    assert stats.visual(np.array([[1000, 3000]], np.uint16), True).values["max"][0] == 3000


def test_sampling():
    at = pixels.sample_frames(474)
    assert len(at) == 101 and 237 in at and 236 not in at and at[-1] == 473
    assert pixels.sample_frames(1).tolist() == [0] and pixels.sample_frames(5).tolist() == [0, 1, 2, 3, 4]
    assert [pixels.sample_stride(w, 10) for w in (299, 300, 449, 450, 1920)] == [1, 2, 2, 3, 12]


def test_resize_and_raw_types():
    assert pixels.resize_indices(8, 3).tolist() == [1, 4, 6] and pixels.resize_indices(3, 3).tolist() == [0, 1, 2]
    assert pixels.resize(np.arange(12).reshape(3, 4, 1), 2, 1).ravel().tolist() == [5, 7]
    assert pixels.raw_type(12, 2, 2, False) == np.uint8 and pixels.raw_type(8, 2, 2, True) == np.uint16 and pixels.raw_type(16, 2, 2, True) == np.float32
    with pytest.raises(DatasetError):
        pixels.raw_type(13, 2, 2, False)


def test_depth_goldens():
    how = Depth()
    levels = quantize(np.array([2000, 3000], np.uint16), how, True)
    assert levels.tolist() == [1365, 1873] and dequantize(levels, how).tolist() == [1999, 3000]
    assert quantize(np.array([2.0, 3.0]), how, False).tolist() == [1365, 1873]
    assert abs(dequantize(levels, how, "m")[0] - 2) < 0.01


@given(st.lists(st.floats(0.01, 10.0), min_size=1, max_size=20), st.booleans())
def test_depth_round_trip(values, log):
    how = Depth(log=log)
    x = np.array(values, np.float32)
    assert np.abs(dequantize(quantize(x, how, False), how, "m") - x).max() < 0.01


def test_depth_errors():
    for bad in (Depth(1, 1), Depth(0, 1, -1, True), Depth(0, float("inf")), Depth(0.0, 1e-46, 0, False)):
        assert not bad.valid()
    with pytest.raises(DatasetError, match="finite"):
        quantize(np.array([np.nan]), Depth(), False)
    with pytest.raises(DatasetError, match="outside"):
        quantize(np.array([11.0]), Depth(clip=False), False)
    with pytest.raises(DatasetError, match="logarithmic"):
        quantize(np.array([-4.0]), Depth(), False)
    with pytest.raises(DatasetError):
        dequantize(np.array([1], np.uint16), Depth(), "cm")
