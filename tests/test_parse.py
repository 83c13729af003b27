"""Line validity rules."""

from helpers import lines_df

from chainsift.operators.parse import decode_fill_lines, decode_misc_lines

GOOD_EVENTS = '[["0xa",{"px":"1"}]]'


def reasons(spark, values, misc=False):
    df = lines_df(spark, values)
    d = decode_misc_lines(df) if misc else decode_fill_lines(df)
    return {r["value"]: (r["reason"], r["block"]) for r in d.collect()}


def test_valid_and_zero_values(spark):
    r = reasons(spark, [
        '{"block_number":5,"events":' + GOOD_EVENTS + "}",
        '{"block_number":null,"events":null}',
        "{}",
        '{"block_number":7,"events":[null,["x"]]}',
    ])
    assert r['{"block_number":5,"events":' + GOOD_EVENTS + "}"] == (None, 5)
    assert r['{"block_number":null,"events":null}'] == (None, 0)
    assert r["{}"] == (None, 0)
    assert r['{"block_number":7,"events":[null,["x"]]}'] == (None, 7)


def test_whole_line_rejections(spark):
    r = reasons(spark, [
        "junk {",
        '{"block_number":1} x',  # trailing text (Q17)
        '{"block_number":1},{"block_number":2}',
        "[1]",
        '{"block_number":"5"}',
        '{"block_number":5.0}',
        '{"block_number":9223372036854775808}',
        '{"block_number":1,"block_time":5}',
        '{"block_number":1,"events":{"a":1}}',
        '{"block_number":1,"events":[{"a":1}]}',
        "{'block_number':1}",
    ])
    assert r["junk {"][0] == "not_json"
    assert r['{"block_number":1} x'][0] == "not_json"
    assert r['{"block_number":1},{"block_number":2}'][0] == "not_json"
    assert r["[1]"][0] == "not_object"
    assert r['{"block_number":"5"}'][0] == "bad_block_number"
    assert r['{"block_number":5.0}'][0] == "bad_block_number"
    assert r['{"block_number":9223372036854775808}'][0] == "bad_block_number"
    assert r['{"block_number":1,"block_time":5}'][0] == "bad_time"
    assert r['{"block_number":1,"events":{"a":1}}'][0] == "bad_events"
    assert r['{"block_number":1,"events":[{"a":1}]}'][0] == "bad_event_element"
    assert r["{'block_number':1}"][0] == "not_json"


def test_blank_lines_are_neither_good_nor_bad(spark):
    d = decode_fill_lines(lines_df(spark, ["", "   ", '{"block_number":1}']))
    assert d.count() == 1


def test_duplicate_keys_last_wins(spark):
    r = reasons(spark, ['{"block_number":1,"block_number":2}'])
    assert r['{"block_number":1,"block_number":2}'] == (None, 2)


def test_case_sensitive_keys(spark):
    # Documented difference: a differently cased key is just another key.
    r = reasons(spark, ['{"Block_Number":3}'])
    assert r['{"Block_Number":3}'] == (None, 0)


def test_misc_rules(spark):
    r = reasons(spark, [
        '{"block_number":-1,"events":[]}',
        '{"block_number":4,"events":[["x"]]}',
        '{"block_number":4,"events":[{"time":5}]}',
        '{"block_number":4,"events":[{"inner":[1]}]}',
        '{"block_number":4,"events":[null,{"time":"t","hash":"h","inner":{}}]}',
    ], misc=True)
    assert r['{"block_number":-1,"events":[]}'][0] == "bad_block_number"
    assert r['{"block_number":4,"events":[["x"]]}'][0] == "bad_event_element"
    assert r['{"block_number":4,"events":[{"time":5}]}'][0] == "bad_event_element"
    assert r['{"block_number":4,"events":[{"inner":[1]}]}'][0] == "bad_event_element"
    assert r['{"block_number":4,"events":[null,{"time":"t","hash":"h","inner":{}}]}'] == (None, 4)
