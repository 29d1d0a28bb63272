"""Short and wide secrets: passwords that are assigned, and those of connection strings."""

from quillspark.llm import secrets


def test_short_and_wide_secrets(spark):
    texts = {
        1: ('password = "Xk29fPq7wz"', ["Xk29fPq7wz"]),
        2: ("set pwd=Gh7!kQ2$z now", ["Gh7!kQ2$z"]),
        3: ("use postgres://u:S3cr3tQ9@host/db here", ["S3cr3tQ9"]),
        4: ("password: required for all users", []),
        5: ("the token: sentence of the text", []),
        6: ("see https://host.example.com:8080/path and Xk29fPq7wz alone", []),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    found = {i: [] for i in texts}
    for r in secrets.scan(df).collect():
        if r["is_secret"]:
            found[r["doc_id"]].append(r["value"])
    assert found == {i: v for i, (_, v) in texts.items()}
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert masked[3] == f"use postgres://u:{secrets.MASK}@host/db here"
