"""Round trips and second implementations of op3, op4, op6 and op8 on small odd tables."""

import base64
import hashlib
import re
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from screenspark.llm import bpe, exact_dedup, media, warc

ODD = [None, "", " ", "a", "a", "a  b", "a\tb", "Grüße 𝔘 \u0000 x", "lorem ipsum " * 3000, "z" * 5000, "   \n\n  tail ", "'s 12345 don't"]


def table(spark, texts, name="text", key="doc_id"):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], f"{key} long, {name} string, digest string")


def test_media_payload_comes_back(spark):
    found = {r.doc_id: r for r in media.media_columns(media.store_media(table(spark, ODD))).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert found[3].media_sha256 == found[4].media_sha256
    assert media.media_columns(media.store_media(table(spark, []))).count() == 0


def test_tokens_equal_the_tokenizers_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(str(path))
    known.no_truncation()
    known.no_padding()
    for r in bpe.token_digests(table(spark, ODD), path).collect():
        ids = known.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        text = known.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_archives_keep_the_smallest_page_as_response(spark):
    pages = table(spark, ODD, "html", "page_id").withColumnRenamed("digest", "url")
    first = {}
    for i, t in enumerate(ODD):
        first.setdefault(t or "", i)
    rows = warc.archive_pages(pages, 0).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        raw, at = (ODD[r.page_id] or "").encode(), first[ODD[r.page_id] or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if at == r.page_id else ("revisit", at))


def test_loser_tree_merges_any_number_of_runs():
    for n in range(6):
        runs = [[(i * 7 + k * 3) % 11 for k in range(i)] for i in range(n)]
        assert list(warc.LoserTree([sorted(r) for r in runs], lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_exact_copies(spark):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in ODD]
    rows = exact_dedup.exact_duplicates(table(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        own = [i for i, t in enumerate(norm) if t == norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (own[0], len(own), own[0] == r.doc_id, hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0
