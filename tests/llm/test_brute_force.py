"""Registered queries on small folders against plain loops over all rows."""

import random
import zlib

import zstandard

from scoreloom.llm import langid, queries


def test_language_query_equals_brute_force(spark, tmp_path):
    words = {"aa": "th ing er the and".split(), "bb": "eau oux que les mente".split(), "cc": "sch ung keit der lich".split()}

    def text(i):
        r = random.Random(i)
        return " ".join("".join(r.choice(words[("aa", "bb", "cc")[i % 3]]) for _ in range(r.randint(1, 3))) for _ in range(r.choice([1, 3, 40])))

    rows = [(i, text(i), ("aa", "bb", "cc")[i % 3], "s", 0) for i in range(240)] + [(900, None, "aa", "s", 0), (901, "12 !", None, None, None), (902, text(1) * 3000, None, "s", 0), (903, "É日本", "bb", "s", 0), (7, text(7), "bb", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    learned = langid.fit_dictionaries(docs)
    # Only rows that are not held out are learned from.
    for lang, dictionary in learned.items():
        for i, t, own, *_ in rows:
            if own == lang and t and zlib.crc32(str(i).encode()) % 5 == 0 and len(t) > 80 and not any(t == u and zlib.crc32(str(j).encode()) % 5 for j, u, *_ in rows):
                assert langid.prepared(t) not in dictionary
    want = []
    for i, t, *_ in rows:
        sizes = {}
        for lang, dictionary in learned.items():
            parameters = zstandard.ZstdCompressionParameters(**langid.COMPRESSION, write_content_size=False)
            made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
            sizes[lang] = len(made.compress(" ".join("".join(c if ord(c) > 127 or c.isalpha() else " " for c in (t or "").lower()).split()).encode()))
        has_letter = any(c.isalpha() for c in t or "")
        want.append((i, zlib.crc32(str(i).encode()) % 5 == 0, min(sizes, key=sizes.get) if has_letter else "und"))
    got = [(r.doc_id, r.held_out, r.lang_pred) for r in queries.op5_compression_langid(spark, str(tmp_path)).collect()]
    differ = set(got) ^ set(want)
    assert len(got) == len(want) and not differ
