"""Schemas of the text inputs, in file order, as DDL strings."""

TAG_EXIT_PLAZA = "tag string, plaza string, lane string, time timestamp_ntz"
TAG_PLAZA = "tag string, plaza string, time timestamp_ntz"
TAG_PLAZA_LANES = "tag string, plaza string, entry_lane string, exit_lane string, time timestamp_ntz"
PLAZA_DISTANCE = "from_place string, to_place string, distance double"
PREV_PLAZA_LANE = (
    "plaza string, lane string, prev_plaza string, prev_lane string, "
    "count bigint, total bigint, percent double, mean_hours double"
)
TAG_MASTER = "tag string, class string, classcode string, com string"
TAG_VEHICLE = ("tag", "vehicle_number", "state")  # ragged: the third field may be missing
IMPROPER_REG_NO = "tag string, registration string"
STATE_CODE = "code string, state_name string"
CLASS_PLAZA_AMOUNT = "vehicle_class string, plaza string, amount double, frequency int"
BLACKLISTED_TXN = ("tag", "plaza")  # ragged
TAG_VEHICLE_CLASS = "tag string, vehicle_class string"
VEHICLE_TAG_TIME = "vehicle_number string, tag string, time timestamp_ntz"
GROUPED_VEHICLE_TAG = "vehicle_number string, tag string, count int"
TRAVEL_TIME = (
    "tag string, time timestamp_ntz, plaza string, prev_plaza string, "
    "prev_time timestamp_ntz, distance double, time_diff double"
)
RATINGS = "user int, item int, rating double, ts bigint"
ITEMS = "item int, title string"
PEOPLE = "id int, name string, age int, num_friends int"
WEATHER = "station string, date string, entry_type string, temperature double"
CUSTOMER_ORDERS = "customer string, item string, amount double"

# The shared Parquet tables. Reading with a schema saves a footer job per use.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}
