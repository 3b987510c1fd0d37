import pytest

from vecloom.params import IndexSpec, SearchParams, parse_index, parse_search


def test_specs():
    assert parse_index("Flat") == IndexSpec() and parse_index("Flat").kind == "flat"
    assert parse_index("IVF4096,PQ16") == IndexSpec(4096, 16) and parse_index("IVF4096,PQ16").kind == "ivf_pq"
    assert parse_index("IVF64, Flat").kind == "ivf_flat"
    assert parse_index("PQ32x4", "ip") == IndexSpec(0, 32, 4, "ip") and parse_index("PQ32").ksub == 256
    assert parse_index("IVF4096,PQ8+16") == IndexSpec(4096, 8, fine=16) and parse_index("PQ8x6+16") == IndexSpec(0, 8, 6, fine=16)
    assert parse_index("PCA80,Flat") == IndexSpec(axes=80) and parse_index("PCA32, IVF64, PQ8") == IndexSpec(64, 8, axes=32)
    assert parse_index("IVF10,PQ4").precomputed_terms == 10 * 4 * 256


@pytest.mark.parametrize("spec", ["IMI2x8,PQ16", "OPQ16_64,IVF10,PQ16", "IMI2x8,PQ8+16"])
def test_refused(spec):
    with pytest.raises(NotImplementedError):
        parse_index(spec)


@pytest.mark.parametrize("spec", ["", "PCA80", "PCA0,Flat", "IVF4,PCA8,Flat", "Flat+8", "PQ8+", "IVF0,Flat", "IVF10", "PQ", "Flat,PQ8", "nonsense"])
def test_wrong(spec):
    with pytest.raises(ValueError):
        parse_index(spec)


def test_search_params():
    assert parse_search("nprobe=32") == SearchParams(10, 32)
    assert parse_search("k=100, nprobe=8") == SearchParams(100, 8)
    assert parse_search("factor=2,k=5") == SearchParams(5, 1, 2)
    assert parse_search("", SearchParams(3, 4)) == SearchParams(3, 4)
    with pytest.raises(ValueError):
        parse_search("nprobe=0")
