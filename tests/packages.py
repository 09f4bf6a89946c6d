"""Package fixtures, built in memory."""

import json

from tarn.sources.container import encode

APP = json.dumps({"pages": ["pages/home/index"]}).encode()
STANDARD = {"app.json": APP, "app.js": b"App({})", "pages/home/index.js": b"Page({})", "pages/home/index.wxml": b"<view>home</view>", "pages/home/index.wxss": b".a{}"}
FOUR_X = {"app-config.json": json.dumps({"pages": ["pages/home/index"], "global": {"window": {"navigationBarTitleText": "Demo"}}}).encode(), "app-service.js": b"", "page-frame.html": b"<html></html>", "app-wxss.js": b""}
GAME = {"app-config.json": b"{}", "game.js": b"", "game.json": b"{}"}


def table(spark, **packages):
    return spark.createDataFrame([(k, bytearray(v if isinstance(v, bytes) else encode(v))) for k, v in packages.items()], "pkg_id string, content binary")
