"""Archive files are bounded by bytes, whatever the pages' sizes."""

import glob
import os
import random

from quillmere.llm import warc
from quillmere.session import shared_dir


def test_files_are_bounded_by_bytes(spark):
    rng = random.Random(1)
    noise = lambda n: "".join(chr(rng.randrange(33, 10_000)) for _ in range(n))
    rows = [(k, f"http://x/{k}", noise(rng.choice([0, 50, 3_000, 12_000]))) for k in range(120)] + [(None, None, None), (500, "http://y", noise(90_000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    bounded, path = pages.filter("coalesce(page_id, 0) <> 500"), shared_dir(spark, "archive")
    warc.write_archive(bounded, path, file_bytes=200_000)
    sizes = [os.path.getsize(f) for f in glob.glob(f"{path}/*.txt")]
    assert len(sizes) >= 10 and max(sizes) <= 200_000
    assert warc.merged_index(spark, path).count() == 121
    path = shared_dir(spark, "archive")
    warc.write_archive(pages, path, file_bytes=200_000)  # one page is larger than a file
    assert warc.merged_index(spark, path).count() == 122
    assert warc.records_of_a_file(pages) == warc.FILE_RECORDS
    assert warc.records_of_a_file(pages.limit(0)) == warc.FILE_RECORDS
