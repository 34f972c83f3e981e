"""Cleaning of skill points as they are written."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class PointRules:
    """What is no skill point. The defaults are fixed values."""

    brands: Sequence[str] = ("天猫精灵", "小米", "华为", "苹果", "大疆", "海康威视", "海康", "大华", "宇视", "西门子", "三菱", "欧姆龙", "松下", "基恩士", "汇川", "台达", "施耐德", "ABB", "罗克韦尔", "倍福", "菲尼克斯", "阿里", "腾讯", "百度", "字节", "抖音", "美团", "京东", "拼多多", "快手", "讯飞", "商汤", "旷视", "依图", "云从", "英伟达", "高通", "博通", "联发科", "紫光", "长江存储", "中芯国际", "寒武纪", "地平线", "泰凌", "瑞昱", "乐鑫", "博流", "沁恒", "兆易创新")
    devices: Sequence[str] = ("示波器", "万用表", "电烙铁", "热风枪", "贴片机", "回流焊", "波峰焊", "AOI", "X-Ray", "三坐标", "二次元影像仪", "三次元", "投影仪", "卡尺", "千分尺", "钳表", "电桥", "频谱仪", "信号发生器", "逻辑分析仪", "耐压仪")
    general: Sequence[str] = ("平台层", "软件系统", "办公软件", "计算机", "电脑", "互联网", "大数据", "人工智能", "云计算", "二次元", "自动化", "数字化", "智能化", "系统", "平台", "软件", "硬件")
    endings: Sequence[str] = ("芯片", "测试仪", "测量仪", "分析仪", "传感器", "电阻", "电容", "模组")
    makers: Sequence[str] = ("西门子", "三菱", "欧姆龙", "汇川", "台达", "松下", "施耐德", "基恩士")
    products: Sequence[str] = ("PLC", "伺服", "变频器", "触摸屏", "WinCC")
    shortest: int = 2
    longest: int = 30


_WIDE = "".join(chr(c) for span in (range(0xFF21, 0xFF3B), range(0xFF41, 0xFF5B), range(0xFF10, 0xFF1A)) for c in span)
_PLAIN = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


def cleaned(points: Column, rules: PointRules = PointRules()) -> Column:
    """An array of points with full-width letters and digits as ASCII, blanks folded, marks at the ends taken off and a maker before its product left
    out; without those too short or too long, brands, devices, general words and parts by their endings; of spellings that differ in case
    only the first. Null points go; a null array is empty.
    """
    folded = F.transform(F.coalesce(points, F.array().cast("array<string>")), lambda p: F.trim(F.regexp_replace(F.translate(p, _WIDE, _PLAIN), r"\s+", " "), F.lit(" ，,、；;·")))
    named = F.create_map(*[x for m in rules.makers for p in rules.products for x in (F.lit(m + p), F.lit(p))]) if rules.makers and rules.products else None
    bare = F.transform(folded, lambda p: F.coalesce(named[p], p)) if named is not None else folded
    refused = F.array(*map(F.lit, [*rules.brands, *rules.devices, *rules.general] or [""]))

    def stands(p: Column) -> Column:
        good = F.length(p).between(rules.shortest, rules.longest) & ~F.array_contains(refused, p)
        for ending in rules.endings:
            good = good & ~F.endswith(p, F.lit(ending))
        return p.isNotNull() & good

    kept = F.filter(bare, stands)
    return F.filter(kept, lambda p, i: F.array_position(F.transform(kept, lambda q: F.lower(q)), F.lower(p)) == i + 1)
