import json

from leafgrid import streaming


def test_each_document_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    item = {"item_id": "fig_0001", "type": "figure", "subtype": "unknown", "page_index": 1, "bbox": [0, 0, 1, 1], "caption": ""}
    row = {"doc_id": "a", "created_at": "2024-01-01T00:00:00Z", "manifest": json.dumps({"items": [item, item | {"item_id": "table_0001", "type": "table"}]})}
    for k in range(2):
        (folder / f"{k}.json").write_text(json.dumps(row) + "\n")
    (folder / "2.json").write_text(json.dumps(row | {"doc_id": "b", "created_at": "2024-01-01T00:05:00Z"}) + "\n")
    out = streaming.items(streaming.manifests(spark, str(folder), 1))
    q = out.writeStream.format("memory").queryName("streamed_items").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.doc_id, r.item_id) for r in spark.table("streamed_items").collect())
    assert got == [("a", "fig_0001"), ("a", "table_0001"), ("b", "fig_0001"), ("b", "table_0001")]
