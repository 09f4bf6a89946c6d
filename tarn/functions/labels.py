"""Codes of stages, engines and states with the labels that reports show: a lookup in a literal map."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels by stage, engine and result, and the label of a stage that has none.
STAGES = {
    "uploading": "上传文件", "processing": "准备反编译", "queued": "等待处理", "classifying": "识别文件", "decrypting": "检查并解密文件", "unpacking": "解包文件", "normalizing": "整理文件结构",
    "recovering_manifest": "整理应用配置", "recovering_js": "还原程序逻辑", "recovering_wxml": "还原页面结构", "recovering_wxss": "还原页面样式", "fallback_recovering": "尝试补全内容",
    "formatting": "整理代码格式", "verifying": "检查文件结构与语法", "packaging": "生成下载文件", "completed": "结果已生成", "partial": "部分内容需检查", "failed": "反编译未完成",
}
OTHER_STAGE = "处理当前步骤"
ENGINES = {
    "native": "内置反编译", "fallback": "辅助反编译", "safe-format": "代码格式整理", "parser": "语法与引用检查", "static-verifier": "静态质量检查", "subpackage-guard": "分包保护模式", "disabled": "未启用",
}
RESULTS = {"partial": "可下载 · 需检查", "failed": "未完成"}
RESULT = "可下载"


def label(code: Column, labels: Mapping[str, str], default: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(known, code), default)


def stage_label(stage: Column) -> Column:
    return label(stage, STAGES, F.lit(OTHER_STAGE))


def engine_label(engine: Column) -> Column:
    """An engine without a label is shown by name, none as nothing."""
    return label(engine, ENGINES, F.coalesce(engine, F.lit("")))


def result_label(status: Column) -> Column:
    return label(status, RESULTS, F.lit(RESULT))


def stage_tone(status: Column, partial: Column, success: Column) -> Column:
    """What a stage's state says, a partial success before a success."""
    return (
        F.when(F.coalesce(partial, F.lit(False)) | (status == "partial"), "warning").when(F.coalesce(success, F.lit(False)) | (status == "success"), "success")
        .when(status.isin("queued", "pending", "running", "processing"), "neutral").otherwise("danger")
    )
