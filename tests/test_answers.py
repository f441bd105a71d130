"""Live answers: frames out of order and twice, a gap that waits, and one that is given up."""

import json
import time

from lectern.streaming import answers, firings

SCHEMA = "response_id string, seq bigint, block string"


def block(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def run(spark, folder, batches, **options):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", firings.STATE_STORE)
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = answers.stream_answers(stream, **options)
    writer = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt")
    if "timeout_ms" not in options:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        query = writer.trigger(processingTime="300 milliseconds").start()
        time.sleep(20)  # such a stream never idles
        query.stop()
    pieces = spark.read.schema(out.schema).parquet(f"{folder}/out")
    return {r.response_id: (r.content, r.done, r.total_tokens) for r in answers.whole_answers(pieces).collect()}


def test_frames_out_of_order_and_twice(spark, tmp_path):
    end = 'data: {"usage":{"total_tokens":7}}\ndata: [DONE]'
    batches = [
        [("r", 2, block("c")), ("r", 1, "data: {bad"), ("s", 0, block("x")), ("s", 2, block("lost"))],
        [("r", 4, end), ("r", 2, block("c")), ("r", 0, block("a"))],
        [("r", 3, block("d")), ("r", 0, block("a"))],
    ]
    assert run(spark, str(tmp_path), batches) == {"r": ("acd", True, 7), "s": ("x", False, None)}


def test_a_missing_frame_is_given_up(spark, tmp_path):
    assert run(spark, str(tmp_path), [[("s", 0, block("x")), ("s", 3, block("z")), ("s", 2, block("y"))]], timeout_ms=1_000) == {"s": ("xyz", False, None)}
