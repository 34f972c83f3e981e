"""Which evidence supports a skill directly, and lines of a text that no evidence covers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions import layout
from loomgraph.operators.intervals import longest


@dataclass(frozen=True)
class EvidencePolicy:
    """Headings and markers. The defaults are fixed values; regular expressions don't mind case."""

    opening: str = "简介/优势"
    headings: Sequence[str] = ("求职意向", "教育经历", "工作经历", "项目经历", "期刊论文", "会议论文", "授权专利", "荣誉奖项", "校园经历", "资格证书", "专业技能")
    result_only: Sequence[str] = ("求职意向", "期刊论文", "会议论文", "授权专利", "荣誉奖项", "资格证书")
    result_text: str = "发表.{0,24}(论文|文章)|(论文|文章).{0,24}(第一作者|通讯作者|SCI|EI|JCR)|(授权|申请|产出|拥有).{0,16}(发明)?专利|一等奖|二等奖|三等奖|获奖|竞赛.{0,12}奖|资格证书|从业资格|通过.{0,12}考试"
    campus: str = "校园经历"
    campus_admin: str = "团委|班级|年会|团务|学生干部|校级活动|学院活动|场地申请|日常事务|共青团|活动策划|组织活动"
    campus_technical: str = "算法|代码|编程|开发|软件|硬件|测试|模型|数据库|机器学习|电路|调试|接口|仿真|控制|信号|OCR|RAG"
    eligible: Sequence[str] = ("简介/优势", "工作经历", "项目经历")
    actions: Sequence[str] = ("负责", "研发", "设计", "实现", "开发", "搭建", "训练", "调优", "优化", "测试", "调试", "分析", "处理", "构建", "建立", "撰写", "评估", "评价", "控制", "部署", "维护", "参与", "主导", "完成", "提出", "采用", "使用", "利用", "制作", "采集", "识别", "检测", "规划", "验证", "迭代", "集成", "编程")
    technical: Sequence[str] = ("算法", "代码", "编程", "开发", "系统", "软件", "硬件", "设备", "测试", "数据", "模型", "网络", "数据库", "AI", "机器学习", "深度学习", "视觉", "电路", "调试", "接口", "仿真", "控制", "信号", "OCR", "RAG", "Python", "C++", "Java", "Linux", "线程", "通信", "图像", "EEG", "脑电", "触觉", "原型", "嵌入式", "交互")
    duties: Sequence[str] = ("主要工作职责", "负责内容", "工作职责", "职责：", "职责:")
    covered: float = 0.6
    shortest: int = 8
    longest: int = 260
    per_section: int = 4
    per_opening: int = field(default=1)


def evidence_sections(texts: DataFrame, evidence: DataFrame, policy: EvidencePolicy) -> DataFrame:
    """`evidence` (doc, ability, text, start, end) with `section`: the heading of `texts` (doc, text) that its start stands under.

    A start outside every range is `未知`; evidence without a place has a null section. Only places are joined, not texts.
    """
    # a document's sections stay in its row, so a place is found without a row for each section
    ranges = texts.where("doc IS NOT NULL").groupBy("doc").agg(F.flatten(F.collect_list(layout.sections(F.col("text"), policy.headings, policy.opening))).alias("_ranges"))
    placed = evidence.where("start IS NOT NULL AND end IS NOT NULL AND doc IS NOT NULL")
    held = F.transform(F.filter("_ranges", lambda x: (x["start"] <= F.col("start")) & (F.col("start") < x["end"])), lambda x: x["section"])
    rows = placed.join(ranges, "doc", "left").withColumn("section", F.explode_outer(held)).withColumn("section", F.coalesce("section", F.lit("未知"))).select(*evidence.columns, "section")
    return rows.unionByName(evidence.where("start IS NULL OR end IS NULL OR doc IS NULL").withColumn("section", F.lit(None).cast("string")))


def direct_evidence(texts: DataFrame, evidence: DataFrame, policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """(…, section, kept) for each row of evidence, and whether its ability is `dropped`.

    What stands under a heading of results only, or tells of papers, patents, prizes and examinations, isn't direct evidence; nor is
    campus administration without technical work. Evidence without a place is kept. An ability (within its document) goes if
    it had placed evidence and none of that is left.
    """
    rows = evidence_sections(texts, evidence, policy)
    text = F.coalesce("text", F.lit(""))
    results = F.col("section").isin(*policy.result_only) | F.regexp_like(text, F.lit(f"(?i){policy.result_text}"))
    administration = (F.col("section") == policy.campus) & F.regexp_like(text, F.lit(policy.campus_admin)) & ~F.regexp_like(text, F.lit(policy.campus_technical))
    told = rows.withColumn("kept", F.col("section").isNull() | ~(results | administration))
    of = Window.partitionBy("doc", "ability")
    placed, left = F.count_if(F.col("section").isNotNull()).over(of), F.count_if(F.col("section").isNotNull() & F.col("kept")).over(of)
    return told.withColumn("dropped", (placed > 0) & (left == 0))


def _count(text: Column, markers: Sequence[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m)))


def uncovered_lines(texts: DataFrame, evidence: DataFrame, policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """(doc, section, rank, text, start, end, covered, score): the best lines of a document that its evidence leaves out.

    Lines of eligible sections with an action and a technical marker, of moderate length, that don't tell of results only and of
    which placed evidence (the best single span) covers less than `covered`. Of such lines alike but for blanks, leading
    marks and digits the first stands. Ranked by score, then place; `per_section` of a section at most, `per_opening` of the opening.
    """
    rows = texts.select("doc", F.inline(layout.lines(F.col("text"), policy.headings, policy.opening)))
    text = F.col("text")
    rows = rows.where(F.col("section").isin(*policy.eligible) & F.length(text).between(policy.shortest, policy.longest) & ~F.regexp_like(text, F.lit(f"(?i){policy.result_text}")))
    rows = rows.withColumns({"actions": _count(text, policy.actions), "technical": _count(text, policy.technical)}).where("actions > 0 AND technical > 0")
    spans = evidence.where("start IS NOT NULL AND end IS NOT NULL").select("doc", "start", "end")
    names = [c for c in rows.columns if c != "doc"]
    by_doc = rows.groupBy("doc").agg(F.collect_list(F.struct(*names)).alias("_lines"))
    spans = spans.where("doc IS NOT NULL").groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    met = by_doc.join(spans, "doc", "left").withColumn("_most", longest(F.col("_lines"), F.col("_spans")))
    rows = met.select("doc", F.explode(F.arrays_zip("_lines", "_most")).alias("_x")).select("doc", "_x._lines.*", F.col("_x._most").alias("most"))
    covered = F.coalesce("most", F.lit(0)) / (F.col("end") - F.col("start"))
    rows = rows.withColumn("covered", covered).where(F.col("covered") < policy.covered)
    alike = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", ""), "^[•\\-·0123456789.、]+", "")
    first = F.row_number().over(Window.partitionBy("doc", "alike").orderBy("start"))
    rows = rows.withColumn("alike", alike).where("alike <> ''").withColumn("nth", first).where("nth = 1")
    duty = F.when(_count(text, policy.duties) > 0, 5).otherwise(0)
    score = 2.0 * F.col("actions") + F.col("technical") + duty + 4.0 * (1 - F.col("covered")) + F.least(F.length(text) / 100, F.lit(1.5))
    place = F.row_number().over(Window.partitionBy("doc", "section").orderBy(F.desc("score"), "start", "end"))
    most = F.when(F.col("section") == policy.opening, policy.per_opening).otherwise(policy.per_section)
    return rows.withColumn("score", score).withColumn("rank", place).where(F.col("rank") <= most).select("doc", "section", "rank", "text", "start", "end", "covered", "score")
