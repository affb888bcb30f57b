"""Table schemas, as DDL."""

EXCHANGES = (
    "exchange_id BIGINT, ts TIMESTAMP, tool STRING, method STRING, url STRING, req_headers ARRAY<STRING>, "
    "req_body BINARY, resp_headers ARRAY<STRING>, resp_body BINARY"
)
SURFACES = "exchange_id BIGINT, url STRING, direction STRING, location STRING, ordinal INT, text STRING"
FINDINGS = (
    "exchange_id BIGINT, url STRING, location STRING, kind STRING, title STRING, confidence STRING, value STRING, "
    "hex_len INT, label STRING, candidates ARRAY<STRING>, detail STRING"
)
DECODED = (
    "exchange_id BIGINT, ts TIMESTAMP, direction STRING, host STRING, port INT, tool STRING, origin STRING, "
    "token_len INT, token STRING, route STRING, decoded STRING"
)
