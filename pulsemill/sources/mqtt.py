"""An MQTT subscription as a streaming source: `spark.readStream.format("mqtt")`.

Needs a client library (`paho.mqtt`) on the driver, which is imported only when a stream starts. Messages gather in the
driver between two triggers and are handed out as batches; what a batch has handed out is kept until it is committed.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

HOST, PORT, TOPIC = "localhost", 1883, "sensors/accel"


class MqttReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port, self.topic = options.get("host", HOST), int(options.get("port", PORT)), options.get("topic", TOPIC)
        self.lock, self.held, self.first, self.client = threading.Lock(), [], 0, None

    def connect(self) -> None:
        import paho.mqtt.client as mqtt

        client = mqtt.Client()
        client.on_connect = lambda c, *_: c.subscribe(self.topic)
        client.on_message = lambda _c, _u, message: self.receive(message.topic, bytes(message.payload))
        client.connect(self.host, self.port)
        client.loop_start()
        self.client = client

    def receive(self, topic: str, payload: bytes) -> None:
        with self.lock:
            self.held.append((topic, payload))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.client is None:
            self.connect()
        with self.lock:
            rows = self.held[max(0, start["n"] - self.first) :]
            return iter(rows), {"n": max(self.first, start["n"]) + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with self.lock:
            return iter(self.held[max(0, start["n"] - self.first) : max(0, end["n"] - self.first)])

    def commit(self, end: dict) -> None:
        with self.lock:
            del self.held[: max(0, end["n"] - self.first)]
            self.first = max(self.first, end["n"])


class MqttSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mqtt"

    def schema(self) -> str:
        return "topic string, value binary"

    def simpleStreamReader(self, schema) -> MqttReader:
        return MqttReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MqttSource)
