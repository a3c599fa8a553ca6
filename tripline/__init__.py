"""Security-analytics jobs over audit logs and endpoint telemetry, on Spark.

``tripline.plans`` holds the detections, ``tripline.operators`` the DataFrame
operators they are built from, ``tripline.functions`` column expressions and
``tripline.sources`` the input schemas.
"""
