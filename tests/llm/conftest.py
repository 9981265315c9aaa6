import pytest

CHAT = "id string, task_id string, messages array<struct<role: string, content: string>>, score double, success boolean, split string, source string, author string, created_at timestamp, ingested_at timestamp, cid string, text string, n_words int"
TASK = "id string, category string, description string"
ALIAS = "old_id string, new_id string"


@pytest.fixture(scope="session")
def chats(spark):
    """Builds demo_output-like rows (with extra columns whose names clash with inner ones)."""

    def build(rows):
        out = []
        for r in rows:
            r = {"id": None, "task_id": None, "text": None, "split": "train", "source": "s", "success": True, **r}
            messages = r.get("messages", None if r["text"] is None else [("system", "shared system words"), ("user", r["text"])])
            out.append((r["id"], r["task_id"], messages, 0.5, r["success"], r["split"], r["source"], None, None, None, "clash", "clash", 7))
        return spark.createDataFrame(out, CHAT)

    return build
