from conftest import rows
from tallyshelf.operators.cleaning import apply_row_rules
from tallyshelf.operators.features import add_features
from tallyshelf.sources.files import read_csv, type_columns
from tallyshelf.streaming.lines import landing_stream, processed_stream, write_stream
from test_cleaning import DIRTY, HEADER


def land(folder, name, lines):
    text = "\n".join(",".join("" if v is None else v for v in line) for line in lines)
    (folder / name).write_text(",".join(h.strip() for h in HEADER) + "\n" + text + "\n")


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    landing, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    landing.mkdir()
    land(landing, "a.csv", DIRTY[:6])
    write_stream(processed_stream(landing_stream(spark, str(landing))), out, marks).awaitTermination()
    land(landing, "b.csv", DIRTY[6:])
    # restarted from its checkpoint, the job reads only the new file
    write_stream(processed_stream(landing_stream(spark, str(landing))), out, marks).awaitTermination()
    batch = add_features(apply_row_rules(type_columns(read_csv(spark, str(landing)))))
    stream = spark.read.parquet(out).select(*batch.columns)
    assert stream.count() == 5
    assert rows(stream) == rows(batch)
