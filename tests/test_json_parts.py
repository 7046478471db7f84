"""Elements of large JSON documents, cut anywhere."""

import json
import random

import pytest

from offermill.sources import json_parts
from offermill.sources.json_parts import elements

R = random.Random(4)
TEXTS = ['plain', 'quote " inside', "back\\slash", 'end with \\', '\\" both', "{not [a} bracket]", "é 🙂", "", '":{', "a" * 300]


def value(depth=0):
    kind = R.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return R.choice(TEXTS)
    if kind == 2:
        return R.choice([1, 2.5, None, True])
    if kind == 3:
        return [value(depth + 1) for _ in range(R.randrange(4))]
    return {R.choice(TEXTS) + str(i): value(depth + 1) for i in range(R.randrange(4))}


def item():
    return {"id": R.randrange(10**6), "v": value(), "businesses": [{"nested": 1}], "w": value()}


def nested():
    cities = {c + R.choice(TEXTS): {"x": value(), "businesses": [item() for _ in range(R.randrange(6))], "y": [{"no": 1}]} for c in "abcdef"}
    return {**cities, "broken": {"businesses": {"no": 1}}, "other": [1, {"businesses": [{"no": 2}]}]}


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_nested_documents_cut_anywhere(tmp_path, indent, size):
    """Segments of any size give the same elements; small ones without Spark, by the same folding."""
    document = nested()
    path = tmp_path / "a.json"
    path.write_text(json.dumps(document, indent=indent, ensure_ascii=bool(indent)))
    total = path.stat().st_size
    size = max(size, total // 400) if size < 64 else size
    wanted = json_parts.parse_pointer("$.*.businesses[*]")
    in_string, stack, got = False, [], []
    for lo in range(0, total, size):
        hi = min(lo + size, total)
        segment = json_parts.Segment(str(path), 0, lo, hi, in_string, list(stack))
        got += list(json_parts.read_segment(segment, wanted))
        with json_parts._file(str(path)) as file:
            odd, *states = json_parts._with_keys(file, lo, hi, lambda p: [len(p.inner) % 2, json_parts._summary(p, False), json_parts._summary(p, True)])
        closed, left = states[in_string]
        stack = stack[:max(0, len(stack) - closed)] + left
        in_string ^= bool(odd)
    want = [([c], x) for c, d in document.items() if isinstance(d, dict) and isinstance(d["businesses"], list) for x in d["businesses"]]
    assert [(keys, json.loads(text)) for _, keys, text in got] == want
    assert [p for p, _, _ in got] == sorted({p for p, _, _ in got}) and not in_string and stack == []


def test_data_source(spark, tmp_path):
    """One file by several tasks, several files in order, other pointers, nothing to read."""
    items = [[item() for _ in range(n)] for n in (40, 0, 7)]
    for name, rows in zip("abc", items):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=2))
    df = elements(spark, str(tmp_path), "$[*]", segment_bytes=500)
    rows = df.orderBy("file_number", "position").collect()
    assert [json.loads(r.element) for r in rows] == [x for part in items for x in part]
    assert df.rdd.getNumPartitions() > 10
    seqs = [r[0] for r in df.select(json_parts.sequence_number()).collect()]
    assert len(set(seqs)) == 47
    (tmp_path / "f.txt").write_text(json.dumps({"data": {"x": [{"a": 1}], "children": [{"data": {"children": [{}]}}, 5, {"a": 2}]}}))
    found = [json.loads(r.element) for r in elements(spark, str(tmp_path / "f.txt"), "$.data.children[*]", segment_bytes=11).orderBy("position").collect()]
    assert found == [{"data": {"children": [{}]}}, {"a": 2}]
    assert elements(spark, str(tmp_path / "missing.json"), "$[*]").count() == 0
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"b": [1, 2')
    assert [r.element for r in elements(spark, str(tmp_path / "cut.json"), "$[*]").collect()] == ['{"a": 1}']


@pytest.mark.parametrize("pointer", ["$", "$.a", "$.a.b", "a[*]", "$[0]"])
def test_bad_pointers(pointer):
    with pytest.raises(ValueError):
        json_parts.parse_pointer(pointer)


def test_keys_of_the_outermost_object(spark, tmp_path):
    """Keys are found by many tasks, however the document is cut; arrays have none."""
    document = {**nested(), 'quo"te\\': 1, "k" * 30: [{"no": {"no": 2}}], "": None, "é:{": ":"}
    (tmp_path / "a.json").write_text(json.dumps(document, indent=1, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps([{"no": 1}]))
    for size in (7, 100, 1 << 20):
        found = json_parts.object_keys(spark, str(tmp_path / "a.json"), segment_bytes=size)
        assert sorted(r.key for r in found.collect()) == sorted(document)
        assert size > 100 or found.rdd.getNumPartitions() > 10
    assert json_parts.object_keys(spark, str(tmp_path / "b.json"), segment_bytes=3).count() == 0
    assert json_parts.object_keys(spark, str(tmp_path / "missing.json")).count() == 0


def test_a_segment_takes_little_memory():
    """Several segments are read in one executor: a segment of the usual size takes a few times its bytes."""
    import io
    import tracemalloc

    class File(io.BytesIO):
        def read_at(self, n, start):
            return self.getbuffer()[start:start + n].tobytes()

    text = json.dumps([{"id": i, "text": 'a "quoted" text'} for i in range(200_000)]).encode()
    file = File((text * (json_parts.SEGMENT_BYTES // len(text) + 1))[:json_parts.SEGMENT_BYTES])
    tracemalloc.start()
    json_parts.Piece(file, 0, json_parts.SEGMENT_BYTES, 0)
    assert tracemalloc.get_traced_memory()[1] < 160 << 20
    tracemalloc.stop()


def test_feeds_are_written_and_numbered_by_several_tasks(spark, monkeypatch):
    from offermill.plans import feeds
    from offermill.plans.views import view

    class Tables:
        def __init__(self):
            self.spark = spark

        def __getattr__(self, name):
            return view(spark, "/root/testdata/sf0.001", name)

    monkeypatch.setattr(feeds, "DOCUMENT_ROWS", 50)
    t = Tables()
    n = t.listings.count()
    for write, part in ((feeds._flat, "["), (feeds._businesses, "{"), (feeds._rss, "<?xml")):
        firsts = [r[0][:len(part)] for r in spark.read.text(write(t), wholetext=True).collect()]
        assert len(firsts) > 2 and set(firsts) == {part}
    plan = feeds.feed_flat(t)
    assert sorted(r.place for r in plan.select("place").collect()) == list(range(1, n + 1))
    assert plan.orderBy("place").first().source_deal_id == t.listings.orderBy("seq").first().source_deal_id
