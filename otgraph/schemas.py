"""Fixed schemas. Nothing in the library infers a schema."""

from pyspark.sql import types as T

# Wide telemetry bronze: seven readings, identifiers, damage flag and abnormal-sensor text.
TELEMETRY_SENSORS = [
    "oil_temperature", "water_temperature", "belt_speed", "freezer_temperature",
    "moisture_content", "product_weight", "component_yield_output",
]

TELEMETRY = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in TELEMETRY_SENSORS]
    + [
        T.StructField("timestamp", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("stage_id", T.StringType()),
        T.StructField("damaged_component", T.BooleanType()),
        T.StructField("abnormal_sensor", T.StringType()),
        T.StructField("line_id", T.StringType()),
    ]
)

# Columns the live feed writes; the other five stay NULL.
TELEMETRY_PARTIAL_COLUMNS = [
    "component_id", "line_id", "stage_id", "oil_temperature", "water_temperature",
    "belt_speed", "freezer_temperature", "timestamp",
]

TRIPLES = T.StructType([
    T.StructField("s", T.StringType()),
    T.StructField("p", T.StringType()),
    T.StructField("o", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

MODEL_TRIPLES = T.StructType([
    T.StructField("graph", T.StringType()),
    T.StructField("s", T.StringType()),
    T.StructField("p", T.StringType()),
    T.StructField("o", T.StringType()),
    T.StructField("o_type", T.StringType()),
])

# HTTP / JSON tag payload; ``value`` is dynamic and parsed into a VARIANT after reading.
TAG_PAYLOAD_FIELDS = ["tagPath", "tagProvider", "value", "quality", "qualityCode",
                      "timestamp", "dataType"]

OT_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("tag_path", T.StringType()),
    T.StructField("tag_provider", T.StringType()),
    T.StructField("numeric_value", T.DoubleType()),
    T.StructField("string_value", T.StringType()),
    T.StructField("boolean_value", T.BooleanType()),
    T.StructField("quality", T.StringType()),
    T.StructField("quality_code", T.IntegerType()),
    T.StructField("source_system", T.StringType()),
    T.StructField("ingestion_timestamp", T.LongType()),   # microseconds since the epoch
    T.StructField("data_type", T.StringType()),
    T.StructField("alarm_state", T.StringType()),
    T.StructField("alarm_priority", T.IntegerType()),
])

ASSET_REGISTRY = T.StructType([
    T.StructField("asset_id", T.StringType()),
    T.StructField("asset_type", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("active", T.BooleanType()),
])

SIGNAL_MAPPING = T.StructType([
    T.StructField("tag_path", T.StringType()),
    T.StructField("asset_id", T.StringType()),
    T.StructField("signal_name", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("scale", T.DoubleType()),
    T.StructField("offset", T.DoubleType()),
    T.StructField("active", T.BooleanType()),
])

RDF_MODELS = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("is_template", T.BooleanType()),
    T.StructField("content", T.StringType()),
    T.StructField("creator", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

LEGACY_CSV = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in [
        "sensor_rotation", "sensor_flow", "sensor_temperature", "sensor_speed",
        "sensor_vibration", "sensor_pressure", "component_yield_output"]]
    + [
        T.StructField("timestamp", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("damaged_component", T.BooleanType()),
        T.StructField("abnormal_sensor", T.StringType()),
        T.StructField("machine_id", T.StringType()),
        T.StructField("line_id", T.StringType()),
    ]
)

TAG_LEAF = T.StructType([
    T.StructField("tag_path", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("value_source", T.StringType()),
    T.StructField("value", T.StringType()),
])
