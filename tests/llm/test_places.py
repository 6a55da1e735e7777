"""The join that deals repeated windows to places: as many rows as places, however many partners a stretch's windows have."""

from fadeline.llm import substring


def test_a_place_of_a_repeated_stretch_meets_one_row(spark):
    long = [f"x{k}" for k in range(700)]
    texts = [long[300:340] + ["a"], long[330:380] + ["b"], ["c", *long], [*long[:690], "d"], ["e", *long[2:]]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = substring.repeated(substring.packed_texts(docs)).collect()
    assert max(len(r.parts) for r in found) > 1  # some stretch has windows of different partners
    assert len({(r.row, r.start) for r in found}) == len(found)
