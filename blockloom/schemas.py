"""Row types of the engine's tables. Checksums and bit positions are longs: Spark has no unsigned types."""

from __future__ import annotations

MARKERS = "file_id bigint, bit bigint, kind string, next_level int"
SEGMENTS = "file_id bigint, seq bigint, kind string, start_bit bigint, first_bit int, bit_length bigint, level int, bytes binary"
RAW_BLOCKS = "file_id bigint, block_no bigint, raw binary, raw_length int, rle1_length int"
ENCODED_BLOCKS = "file_id bigint, block_no bigint, payload binary, bit_length bigint, byte_length int, crc bigint"
DECODED_BLOCKS = (
    "file_id bigint, seq bigint, kind string, chunk_no int, start_bit bigint, end_bit bigint, level int, raw binary, "
    "crc bigint, stored_crc bigint, block_length int, error string"
)
STREAM_REPORT = "file_id bigint, streams int, blocks bigint, bytes_out bigint, trailing boolean, error string, exit_code int"
HEADERS = "file_id bigint, seq bigint, crc bigint, randomized boolean, origin int, used int, groups int, selectors int, longest_code int"
