"""Clean values of all eight fields, five spoilt variants of each, and their split, from a seed and row numbers alone.

A clean value is drawn from hashes of (seed, field, row number), so any partition of the rows draws the
same values. It comes in parts, which the variants need to know: separators go between parts, short
forms leave parts out. Every choice is a built-in function of the hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as d
from ..functions.fields import check_digit
from ..sources.scratch import stage, with_positions
from .evaluate import PERTURBATIONS, split_rows

# The words that clean values are made of, and the wrong characters for right ones.
GIVEN = {
    "明": "铭", "伟": "炜", "强": "墙", "华": "桦", "军": "君", "丽": "莉", "静": "净", "燕": "艳", "杰": "捷", "涛": "滔", "波": "拨", "峰": "锋",
    "慧": "惠", "婷": "庭", "鑫": "新", "鹏": "朋", "凯": "恺", "松": "嵩", "亮": "量", "文": "纹", "志": "智", "国": "果", "建": "健", "辉": "晖",
    "磊": "蕾", "洋": "扬", "勇": "涌", "娟": "涓", "敏": "闵", "霞": "瑕", "平": "萍", "刚": "钢", "英": "应", "玉": "育", "萍": "苹", "红": "虹",
    "玲": "铃", "芬": "纷", "兰": "蓝", "洁": "捷", "颖": "赢", "晶": "京", "露": "路", "薇": "微", "梦": "蒙", "瑶": "摇", "佳": "家", "俊": "骏",
    "哲": "折", "睿": "瑞", "博": "伯", "硕": "烁", "聪": "匆", "云": "芸", "月": "玥", "星": "兴", "语": "雨", "若": "洛", "诗": "师", "亦": "易",
    "可": "柯", "心": "欣", "思": "丝", "童": "同", "言": "岩", "沐": "木", "辰": "晨", "宇": "羽", "轩": "宣", "涵": "含", "然": "燃", "嘉": "家",
    "旭": "绪", "昊": "浩", "天": "田", "龙": "隆", "飞": "非", "翔": "祥", "宁": "凝", "怡": "仪", "帅": "率",
}
REGIONS = {
    "北京市": ["北京"],
    "上海市": ["上海"],
    "天津市": ["天津"],
    "重庆市": ["重庆"],
    "河北省": ["石家庄", "唐山", "保定", "邯郸", "廊坊", "沧州"],
    "山西省": ["太原", "大同", "长治", "临汾", "运城"],
    "辽宁省": ["沈阳", "大连", "鞍山", "抚顺", "锦州", "营口"],
    "吉林省": ["长春", "吉林", "四平", "通化", "松原"],
    "黑龙江省": ["哈尔滨", "齐齐哈尔", "大庆", "牡丹江", "佳木斯"],
    "江苏省": ["南京", "苏州", "无锡", "常州", "南通", "徐州", "扬州", "盐城", "镇江", "泰州", "淮安", "连云港", "宿迁"],
    "浙江省": ["杭州", "宁波", "温州", "嘉兴", "绍兴", "金华", "台州", "湖州", "丽水", "衢州", "舟山"],
    "安徽省": ["合肥", "芜湖", "蚌埠", "安庆", "马鞍山", "阜阳", "滁州"],
    "福建省": ["福州", "厦门", "泉州", "漳州", "莆田", "三明", "龙岩"],
    "江西省": ["南昌", "赣州", "九江", "上饶", "宜春", "吉安"],
    "山东省": ["济南", "青岛", "烟台", "潍坊", "淄博", "临沂", "济宁", "泰安", "威海", "日照", "德州", "聊城"],
    "河南省": ["郑州", "洛阳", "开封", "南阳", "新乡", "许昌", "安阳", "焦作", "信阳"],
    "湖北省": ["武汉", "宜昌", "襄阳", "荆州", "黄石", "十堰", "荆门"],
    "湖南省": ["长沙", "株洲", "湘潭", "衡阳", "岳阳", "常德", "郴州", "益阳"],
    "广东省": ["广州", "深圳", "珠海", "佛山", "东莞", "中山", "惠州", "汕头", "江门", "湛江", "肇庆", "茂名"],
    "广西壮族自治区": ["南宁", "柳州", "桂林", "北海", "玉林", "梧州"],
    "海南省": ["海口", "三亚"],
    "四川省": ["成都", "绵阳", "德阳", "宜宾", "南充", "泸州", "乐山", "内江"],
    "贵州省": ["贵阳", "遵义", "六盘水", "安顺", "毕节"],
    "云南省": ["昆明", "曲靖", "玉溪", "大理", "丽江", "红河"],
    "陕西省": ["西安", "宝鸡", "咸阳", "渭南", "榆林", "汉中"],
    "甘肃省": ["兰州", "天水", "白银", "酒泉", "庆阳"],
    "青海省": ["西宁", "海东"],
    "内蒙古自治区": ["呼和浩特", "包头", "鄂尔多斯", "赤峰", "通辽"],
    "宁夏回族自治区": ["银川", "石嘴山", "吴忠"],
    "新疆维吾尔自治区": ["乌鲁木齐", "克拉玛依", "喀什", "伊宁"],
    "西藏自治区": ["拉萨", "日喀则"],
    "香港特别行政区": ["香港"],
    "澳门特别行政区": ["澳门"],
}
DISTRICTS = [
    "城关区", "新城区", "东城区", "西城区", "朝阳区", "鼓楼区", "滨江区", "高新区", "经济开发区", "城南区", "城北区", "城东区", "城西区", "河东区", "河西区", "江南区",
    "江北区", "市中区", "市南区", "市北区", "新区", "开发区", "高新技术产业开发区", "中山区",
]
ROADS = [
    "人民路", "中山路", "解放路", "建设路", "新华路", "长江路", "黄河路", "北京路", "文化路", "光明路", "幸福路", "和平路", "青年路", "迎宾大道", "世纪大道", "科技大道",
    "创业路", "兴业路", "环城路", "滨江路", "花园路", "学院路", "朝阳路", "民主路", "团结路", "胜利路", "育才路", "振兴路", "富民路", "望江路",
]
PHONE_STARTS = [
    "130", "131", "132", "133", "134", "135", "136", "137", "138", "139", "145", "147", "149", "150", "151", "152", "153", "155", "156", "157", "158", "159", "165", "166",
    "167", "170", "171", "172", "173", "175", "176", "177", "178", "180", "181", "182", "183", "184", "185", "186", "187", "188", "189", "190", "191", "192", "193", "195",
    "196", "197", "198", "199",
]
BRANDS = [
    "云栖", "华宇", "恒信", "天工", "明远", "卓越", "盛世", "华夏", "东方", "中天", "联创", "启明", "拓普", "博远", "弘毅", "智联",
    "汇通", "远景", "星河", "蓝海", "绿洲", "磐石", "天翼", "木森", "宏图", "万邦", "精诚", "拓维", "新元", "昌隆", "益丰", "广厦",
    "润泽", "开元", "鼎盛", "立信", "卓远", "光谷", "未来", "云图", "数联", "智远", "慧通", "环宇", "泰和", "恒通", "众诚", "一诺",
    "金诚", "众和", "星辰", "岩松", "清源", "嘉禾", "骏驰", "鹏程", "思创", "维信", "中科", "天成", "瑞泰", "德胜", "信达", "康泰",
    "鑫源", "利丰", "华瑞", "润和", "三江", "九鼎",
]
TRADES = [
    "科技", "网络", "信息", "教育", "文化", "传媒", "贸易", "实业", "电子", "生物", "医药", "环保", "智能", "数据", "软件", "物流",
    "供应链", "建筑", "机械", "食品", "农业", "新能源", "数智", "咨询",
]
FORMS = [
    "有限公司", "有限责任公司", "股份有限公司", "集团有限公司",
]
DOMAINS = [
    "gmail.com", "qq.com", "163.com", "126.com", "sina.com", "sohu.com", "foxmail.com", "outlook.com", "hotmail.com",
    "yahoo.com", "aliyun.com", "139.com", "189.cn", "example.com", "company.net", "school.edu", "test.org", "mail.cn",
]
ADDRESS_MISTAKES = {
    "市": "式", "区": "曲", "路": "露", "号": "豪", "栋": "洞", "室": "式", "楼": "搂", "城": "诚", "湖": "胡", "州": "洲", "阳": "杨", "江": "姜",
    "山": "杉", "新": "欣", "东": "冬", "西": "茜", "南": "楠", "北": "贝", "大": "太", "道": "到", "街": "介", "苑": "园", "滨": "宾", "桥": "乔",
}
COMPANY_MISTAKES = {
    "公": "工", "司": "词", "有": "友", "限": "线", "责": "则", "份": "分", "集": "积", "团": "困", "技": "记", "易": "意", "业": "叶", "络": "落",
    "信": "芯", "息": "希", "电": "店", "子": "宇", "智": "志", "咨": "资",
}
PHONE_MISTAKES = {
    "0": "O", "1": "l", "2": "Z", "3": "E", "5": "S", "8": "B",
}
DIGIT_MISTAKES = {
    "0": "O", "1": "l", "2": "Z", "3": "E", "4": "A", "5": "S", "6": "G", "7": "T", "8": "B", "9": "q",
}
EMAIL_MISTAKES = {
    "0": "o", "1": "l", "2": "z", "5": "s", "6": "g", "8": "b", "o": "0", "l": "1", "z": "2", "s": "5", "g": "6", "b": "8",
}
SPACES = [
    " ", "　",
]
JOINTS = [
    "-", "·", "|", "／", "，",
]
#: What stands around noisy values; a label ends in a colon and goes in front.
NOISE = {
    "person": ["姓名：", "名字:", "先生", "女士", "老师", "（本人）"],
    "address": ["地址：", "住址:", "（收货地址）", "（已搬迁）", "（老地址）", "。"],
    "phone": ["电话：", "手机:", "（微信同号）", "（本人）", "（备用）", "。"],
    "company": ["单位：", "公司名称:", "（总部）", "（原单位）", "（分公司）", "。"],
    "amount": ["金额：", "金额:", "费用：", "（含税）", "（未税）", "。"],
    "date": ["日期：", "日期:", "（录入日期）", "（生效日）", "。"],
    "idcard": ["身份证号：", "身份证:", "证件号：", "（复印件）", "（本人）", "。"],
    "email": ["邮箱：", "邮箱:", "Email:", "（工作邮箱）", "（常用）", "。"],
}

#: Right characters to wrong ones, by field.
TYPOS = {
    "person": GIVEN, "address": ADDRESS_MISTAKES, "company": COMPANY_MISTAKES, "phone": PHONE_MISTAKES,
    "amount": DIGIT_MISTAKES, "date": DIGIT_MISTAKES, "idcard": DIGIT_MISTAKES, "email": EMAIL_MISTAKES,
}
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


@dataclass(frozen=True)
class Draw:
    """Draws from the hash of a seed, the row and a name."""

    seed: int
    row: tuple[str, ...]

    def below(self, name: str, n, *more: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), *self.row, F.lit(name), *more), n if isinstance(n, Column) else F.lit(n)).cast("int")

    def number(self, name: str, low: int, high: int, width: int = 1) -> Column:
        text = (F.lit(low) + self.below(name, high - low + 1)).cast("string")
        return F.lpad(text, width, "0") if width > 1 else text

    def one(self, name: str, words) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), self.below(name, len(words)) + 1)

    def other(self, name: str, value: Column, *candidates: Column) -> Column:
        """One of the candidates that are neither empty nor the value; null if there is none."""
        fit = F.filter(F.array(*candidates), lambda c: (c != "") & (c != value))
        return F.when(F.size(fit) > 0, F.get(fit, self.below(name, F.greatest(F.size(fit), F.lit(1)))))


def piece(s: Column, start: int, length: int) -> Column:
    return F.substr(s, F.lit(start), F.lit(length))


def inserted(s: Column, at: Column, what: Column) -> Column:
    """s with something put in after its first `at` characters."""
    return F.concat(F.substr(s, F.lit(1), at), what, F.substr(s, at + 1))


def without_first(s: Column, word: str) -> Column:
    at = F.instr(s, word)
    return F.when(at > 0, F.concat(F.substr(s, F.lit(1), at - 1), F.substr(s, at + len(word)))).otherwise(s)


def mistyped(draw: Draw, s: Column, table: dict[str, str]) -> Column:
    """s with one of the characters that the table has replaced."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.contains(F.lit("".join(table)), F.substr(s, i, F.lit(1))))
    at = F.coalesce(F.get(places, draw.below("typo", F.greatest(F.size(places), F.lit(1)))), F.lit(0))
    wrong = F.translate(F.substr(s, at, F.lit(1)), "".join(table), "".join(table.values()))
    return F.when(at > 0, F.concat(F.substr(s, F.lit(1), at - 1), wrong, F.substr(s, at + 1))).otherwise(s)


# --- clean values in parts ---


def person_parts(x: Draw) -> list[Column]:
    return [x.one("surname", [*sorted(d.SURNAMES), *d.COMPOUND_SURNAMES]), F.concat(x.one("first", GIVEN), x.one("second", GIVEN))]


def address_parts(x: Draw) -> list[Column]:
    regions = F.array(*[F.struct(F.lit(r).alias("region"), F.array(*[F.lit("" if c in r else c + "市") for c in cities]).alias("cities")) for r, cities in REGIONS.items()])
    region = F.element_at(regions, x.below("region", len(REGIONS)) + 1)
    city = F.element_at(region["cities"], x.below("city", F.size(region["cities"])) + 1)
    room = F.concat(x.number("block", 1, 30), F.lit("栋"), x.number("door", 1, 6), F.lit("单元"), x.number("room", 101, 2508), F.lit("室"))
    return [region["region"], city, x.one("district", DISTRICTS), x.one("road", ROADS), F.concat(x.number("house", 1, 1999), F.lit("号")), F.when(x.below("long", 10) < 6, room).otherwise("")]


def phone_parts(x: Draw) -> list[Column]:
    return [x.one("start", PHONE_STARTS), x.number("middle", 0, 9999, 4), x.number("end", 0, 9999, 4)]


def company_parts(x: Draw) -> list[Column]:
    return [x.one("city", [c for cities in REGIONS.values() for c in cities]), x.one("brand", BRANDS), x.one("trade", TRADES), x.one("form", FORMS)]


def amount_parts(x: Draw) -> list[Column]:
    """Half of the amounts are whole; the last decimal is never 0."""
    fraction = F.element_at(F.array(F.lit(""), F.lit(""), F.concat(F.lit("."), x.number("tenth", 1, 9)), F.concat(F.lit("."), x.number("tenth", 0, 9), x.number("cent", 1, 9))), x.below("kind", 4) + 1)
    return [F.concat(x.number("whole", 1, 9_999_999), fraction), F.lit("元")]


def date_parts(x: Draw) -> list[Column]:
    return [x.number("year", d.FIRST_YEAR, d.LAST_YEAR), x.number("month", 1, 12, 2), x.number("day", 1, 28, 2)]


def idcard_parts(x: Draw) -> list[Column]:
    region, order = F.concat(F.lit("11"), x.number("region", 0, 9999, 4)), x.number("order", 0, 999, 3)
    birthday = F.concat(x.number("year", 1970, 1999), x.number("month", 1, 12, 2), x.number("day", 1, 28, 2))
    return [region, birthday, order, check_digit(F.concat(region, birthday, order))]


def email_parts(x: Draw) -> list[Column]:
    """A user of 3 to 12 letters and digits that starts with a letter and has a digit, and a domain."""
    size = 3 + x.below("size", 10)
    digit_at = 2 + x.below("digit", size - 1)

    def char(i: Column) -> Column:
        chars = F.when(i == 1, F.lit(LETTERS)).when(i == digit_at, F.lit(DIGITS)).otherwise(F.lit(LETTERS + DIGITS))
        return F.substr(chars, x.below("char", F.length(chars), i) + 1, F.lit(1))

    return [F.array_join(F.transform(F.sequence(F.lit(1), size), char), ""), x.one("domain", DOMAINS)]


#: Parts by field, and what stands between them in a clean value.
MAKERS: dict[str, tuple[Callable[[Draw], list[Column]], str]] = {
    "person": (person_parts, ""), "address": (address_parts, ""), "phone": (phone_parts, ""), "company": (company_parts, ""), "amount": (amount_parts, ""), "date": (date_parts, "-"), "idcard": (idcard_parts, ""), "email": (email_parts, "@"),
}
FIELDS = tuple(MAKERS)


# --- variants ---


def shortened(x: Draw, field: str, v: Column, p: list[Column]) -> Column:
    """Short and variant forms; some can be told back, some can't."""
    if field == "person":
        return x.other("abbrev", v, F.concat(p[0], piece(p[1], 1, 1)), F.concat(p[0], piece(p[1], 2, 1)))
    if field == "address":
        return x.other("abbrev", v, F.substr(v, F.length(p[0]) + 1), without_first(v, "省"), without_first(without_first(v, "省"), "市"))
    if field == "phone":
        return F.concat(x.one("abbrev", ("86", "+86", "086")), v)
    if field == "company":
        swap = lambda old, new: F.when(v.endswith(old), F.concat(F.substr(v, F.lit(1), F.length(v) - len(old)), F.lit(new))).otherwise(v)
        return x.other("abbrev", v, swap("股份有限公司", "股份公司"), swap("有限责任公司", "有限公司"), F.substr(v, F.length(p[0]) + 1), F.concat(*p[:3]))
    if field == "amount":
        scaled = (p[0].cast("decimal(12,2)") * F.lit("0.0001").cast("decimal(5,4)")).cast("string")
        return F.concat(F.regexp_replace(scaled, r"\.?0+\z", ""), F.lit("万元"))
    if field == "date":
        y, m, day = (c.cast("int").cast("string") for c in p)
        return x.other("abbrev", v, F.concat_ws("-", y, m, day), F.concat_ws("-", m, day), F.concat_ws("-", y, m))
    if field == "idcard":
        return F.concat(p[0], F.substr(p[1], F.lit(3)), p[2])
    head = F.substring_index(p[1], ".", 1)
    return x.other("abbrev", v, F.substr(v, F.lit(1), F.length(v) - 1), F.concat(p[0], F.lit("@"), head))


def separated(x: Draw, field: str, v: Column, p: list[Column]) -> Column:
    if field == "amount":
        whole = F.substring_index(p[0], ".", 1)
        grouped = F.concat(F.format_number(whole.cast("long"), 0), F.substr(p[0], F.length(whole) + 1))
        odd = inserted(p[0], 1 + x.below("at", F.greatest(F.length(p[0]) - 1, F.lit(1))), x.one("comma", (",", "，")))
        return x.other("sep", v, F.concat(grouped, F.lit("元")), F.concat(odd, F.lit("元")))
    if field == "date":
        mark = x.one("sep", ("/", ".", "／"))
        return F.concat(p[0], mark, p[1], mark, p[2])
    if field == "idcard":
        return F.concat(p[0], piece(p[1], 1, 4), F.lit("-"), piece(p[1], 5, 2), F.lit("-"), piece(p[1], 7, 2), p[2], p[3])
    if field == "email":
        return F.concat(inserted(p[0], 1 + x.below("at", F.length(p[0]) - 1), x.one("sep", (".", "_"))), F.lit("@"), p[1])
    between, there = x.one("sep", JOINTS), F.filter(F.array(*p), lambda c: c != "")
    return F.aggregate(F.slice(there, 2, 9), F.get(there, F.lit(0)), lambda held, c: F.concat(held, between, c))


def variants(x: Draw, field: str, v: Column, p: list[Column]) -> dict[str, Column]:
    """A value by kind of perturbation."""
    gap = x.one("gap", SPACES)
    if field == "email":
        space = F.concat(p[0], x.one("gap", (" @", "@ ")), p[1])
    else:
        space = inserted(v, 1 + x.below("cut", F.length(v) - 1), gap)
    affix = x.one("noise", NOISE[field])
    return {
        "space": space,
        "typo": F.concat(p[0], mistyped(x, p[1], GIVEN)) if field == "person" else mistyped(x, v, TYPOS[field]),
        "abbrev": shortened(x, field, v, p),
        "sep": separated(x, field, v, p),
        "noise": F.when(affix.rlike("[：:]$"), F.concat(affix, v)).otherwise(F.concat(v, affix)),
    }


# --- whole sets ---


def candidates(spark: SparkSession, field: str, n: int, seed: int) -> DataFrame:
    """(field, n, parts, value) of n drawn values, repeats included."""
    maker, between = MAKERS[field]
    rows = spark.range(n).select(F.lit(field).alias("field"), F.col("id").alias("n"))
    return rows.withColumn("parts", F.array(*maker(Draw(seed, ("field", "n"))))).withColumn("value", F.array_join("parts", between))


def clean_values(spark: SparkSession, per_field: int = 200, seed: int = 42, fields=FIELDS, repeats: bool = False) -> DataFrame:
    """(_pos, id, field, value, n, parts): per_field distinct values of each field, ids field-0001 and on.

    More values are drawn than are needed, and of equal ones the first stays; with too few left, twice as
    many are drawn. Where a field's words don't give as many values, repeats says what happens: without
    it this raises; with it all the values that there are come first, then drawn ones a second time and on.
    """
    drawn, short, found, tables = per_field + per_field // 4 + 50, list(fields), {}, []
    for _ in range(8):
        parts = [candidates(spark, f, drawn, seed).withColumn("rank", F.lit(fields.index(f))) for f in short]
        every = reduce(DataFrame.unionByName, parts)
        distinct = stage(every.groupBy("rank", "field", "value").agg(F.min("n").alias("n"), F.min_by("parts", "n").alias("parts")), "clean-values")
        before, found = found, {r["field"]: r["count"] for r in distinct.groupBy("field").count().collect()}
        full = [f for f in short if found.get(f, 0) >= per_field]
        tables.append(distinct.where(F.col("field").isin(full)).withColumn("again", F.lit(False)))
        short = [f for f in short if f not in full]
        if not short:
            break
        spent = [f for f in short if found.get(f) == before.get(f)] if repeats else []
        if spent:
            first = distinct.where(F.col("field").isin(spent))
            more = every.where(F.col("field").isin(spent)).join(first.select("rank", "n"), ["rank", "n"], "left_anti")
            tables.append(first.withColumn("again", F.lit(False)).unionByName(more.withColumn("again", F.lit(True))))
            short = [f for f in short if f not in spent]
            if not short:
                break
        drawn *= 2
    else:
        raise RuntimeError(f"the words of a field give fewer than {per_field} values")
    placed = stage(with_positions(reduce(DataFrame.unionByName, tables).orderBy("rank", "again", "n").drop("again"), "place"), "clean-places")
    starts = placed.groupBy("rank").agg(F.min("place").alias("start"))
    nth = F.col("place") - F.col("start") + 1
    kept = placed.join(F.broadcast(starts), "rank").withColumn("nth", nth).where(F.col("nth") <= per_field)
    text = F.col("nth").cast("string")
    ident = F.concat_ws("-", "field", F.lpad(text, F.greatest(F.length(text), F.lit(4)), F.lit("0")))
    return kept.select((F.col("rank") * per_field + F.col("nth") - 1).alias("_pos"), ident.alias("id"), "field", "value", "n", "parts")


def dirty_values(clean: DataFrame, seed: int = 42, fields=FIELDS) -> DataFrame:
    """(_pos, id, field, value, truth, perturbation): five variants of each row of clean_values() of these fields."""
    x, v = Draw(seed, ("field", "n")), F.col("value")
    out = None
    for field in fields:
        made = variants(x, field, v, [F.get("parts", F.lit(k)) for k in range(len(MAKERS[field][0](x)))])
        each = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(k).alias("perturbation"), made[k].alias("value")) for j, k in enumerate(PERTURBATIONS)])
        one = clean.where(F.col("field") == field).select("_pos", "id", "field", v.alias("truth"), F.explode(each).alias("_v"))
        out = one if out is None else out.unionByName(one)
    return out.select((F.col("_pos") * len(PERTURBATIONS) + F.col("_v.j")).alias("_pos"), "id", "field", F.col("_v.value").alias("value"), "truth", F.col("_v.perturbation").alias("perturbation"))


def build(spark: SparkSession, per_field: int = 200, seed: int = 42, share: float = 0.2, fields=FIELDS) -> tuple[DataFrame, DataFrame]:
    """Clean rows (_pos, id, field, value) and dirty rows with truth, perturbation and split, of these fields.

    All variants of an id are in its split. Raises if a variant is no other than its truth.
    """
    if per_field < 1 or not 0 <= share < 1:
        raise ValueError("per_field has to be 1 or more, and the share held out in [0, 1)")
    clean = stage(clean_values(spark, per_field, seed, fields), "clean")
    dirty = stage(dirty_values(clean, seed, fields), "dirty")
    same = dirty.where("value IS NULL OR value = truth").orderBy("_pos").first()
    if same:
        raise ValueError(f"{same['id']}: {same['perturbation']} leaves the value as it is")
    return clean.drop("n", "parts"), split_rows(dirty, share, seed)


def split_counts(dirty: DataFrame) -> DataFrame:
    """(field, split, clean, dirty): ids and variants by field and split."""
    return dirty.groupBy("field", "split").agg(F.count_distinct("id").alias("clean"), F.count("*").alias("dirty"))
