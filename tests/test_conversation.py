import pytest

from fathomix.operators import conversation

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def chats(spark):
    return spark.createDataFrame(
        [
            (1, 0, "system", "thredds and erddap are known"),
            (1, 1, "user", "what is on https://a.example.org/erddap/index.html ?"),
            (1, 2, "assistant", "thredds?"),
            (1, 3, "user", "the practical one please"),
            (1, 4, "user", "go over to https://b.example.org/thredds/catalog.html"),
            (1, 5, "user", "which is newer, a.example.org/erddap or b.example.org/thredds?"),
            (1, 6, "user", "thredds again"),
            (2, 0, "user", "any floats around here?"),
            (2, 1, "user", "Look for floats in THREDDS, near the coast."),
            (3, 0, "user", "which is newer, a.example.org/erddap or b.example.org/thredds?"),
            (3, 1, "user", "myerddaps éerddap erddap_x"),
            (4, 0, "assistant", "hello"),
        ],
        SCHEMA,
    )


def test_detect_platforms(chats, rows_of):
    found = {(r["conv_id"], r["turn"]): r["mentioned"] for r in conversation.detect_platforms(chats).collect()}
    assert found[1, 1] == ["erddap"] and found[2, 1] == ["thredds"] and found[2, 0] == [] and found[3, 1] == []
    assert found[3, 0] == ["erddap", "thredds"] and (4, 0) not in found


def test_route_turns(chats, rows_of):
    got = conversation.route_turns(chats)
    assert rows_of(got, "conv_id", "turn", "decision", "active_after") == [
        (1, 1, "switch", "erddap"), (1, 3, "stay", "erddap"), (1, 4, "switch", "thredds"), (1, 5, "model", "thredds"),
        (1, 6, "stay", "thredds"), (2, 0, "model", None), (2, 1, "switch", "thredds"), (3, 0, "model", None), (3, 1, "model", None),
    ]


def test_last_user_text(chats, rows_of):
    got = dict(rows_of(conversation.last_user_text(chats)))
    assert got[1] == "thredds again" and got[4] == ""


def test_registry_and_append(spark, rows_of):
    updates = spark.createDataFrame([("u", 1, "csv", None), ("u", 3, None, "x"), ("v", 2, "nc", "y")], "url string, seq int, response string, note string")
    assert rows_of(conversation.latest_entries(updates, ["url"], "seq"), "url", "response", "note") == [("u", None, "x"), ("v", "nc", "y")]
    assert conversation.append_entries(updates, updates).count() == 6
