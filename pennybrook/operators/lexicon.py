"""The word patterns, category rules and labels that results must agree on."""

from __future__ import annotations

# patterns, matched anywhere in the text
CLOSED_STATUS = "关闭|失败|取消|撤销|撤单|失效|超时"
CLOSED_TEXT = "交易关闭|订单关闭|已关闭|交易失败|支付失败|还款失败|已取消|已撤销|撤单|已失效|交易超时"
REPAYMENT = "还款|偿还|结清|待还|自动扣款|全额还款|最低还款"
INVESTMENT = "银证转账|三方存管|证券|股票|基金|理财|期货|国债|信托|投资|定投"
INVESTMENT_BY_FLAG = "黄金|贵金属|积存金|金条|金价"
FEE = "手续费|服务费|分期手续费|利息|逾期费|违约金|年费|管理费|利费"
INTEREST_INCOME = "收益发放|结息|利息收入|派息|分红|分红发放"
FEE_CONTEXT = "手续费|服务费|逾期费|违约金|管理费|利费"
REFUND_STATUS = "退款成功|已全额退款|已退款|退款完成"
DISCLOSED = r"(?:[¥￥]\s*(\d+(?:\.\d{1,2})?)|[(（]\s*(\d+\.\d{1,2})\s*[)）])"
TRANSFER_HINT_DRAFT = "转账|转出|转入|充值|提现|代付|划转|汇款|转入到|转至|内部|归集|资金归集"
TRANSFER_HINT = "转账|转出|转入|充值|提现|代付|划转|汇款|转至|内部|归集"
OUT_HINTS = "转出|支出|付款|提现|扣款|还款|消费|购买|买入|转到|转给|转至|转入余额宝|转入理财|转出到"
IN_HINTS = "转入|收入|收款|充值|赎回|卖出|收钱|转账给你|转入到|转入零钱|收益发放|结息|派息|分红|利息收入"
SERVICE_FEE = r"(?:服务费|手续费|利息)\s*[:：]?\s*[¥￥]?\s*(\d+(?:\.\d{1,2})?)"

# words that mark a table's header row
HEADER_KEYWORDS = (
    "交易时间", "交易日期", "记账日期", "记账时间", "交易日", "交易金额", "发生额", "本币金额", "金额", "币别", "币种", "收/支", "收支", "交易类型", "交易状态",
    "当前状态", "交易对方", "对方户名", "对方账号", "对方卡号", "对方账户名", "对方开户行", "交易名称", "商户", "商品", "摘要", "备注", "附言", "渠道", "余额", "借/贷",
    "借方", "贷方", "收入", "支出",
)

DIRECTION_WORDS = {"in": ["收入", "收", "贷", "进", "存入", "转入", "credit", "in"], "out": ["支出", "支", "借", "出", "支取", "转出", "debit", "out"]}

# category rules: (category, priority, keywords); of equal priorities the first one counts
RULES = [
    ("food", 10, ("美团", "饿了么", "餐饮", "餐厅", "饭店", "美食", "肯德基", "麦当劳", "星巴克", "瑞幸", "外卖", "食品")),
    ("transport", 10, ("滴滴", "高德", "地铁", "公交", "12306", "铁路", "加油", "停车", "出租车", "打车", "单车", "骑行", "地铁", "航空", "航班")),
    ("groceries", 10, ("超市", "便利店", "生鲜", "永辉", "盒马", "沃尔玛", "家乐福")),
    ("shopping", 10, ("淘宝", "天猫", "京东", "拼多多", "唯品会", "苏宁")),
    ("housing", 20, ("房租", "租金")),
    ("housing", 10, ("物业",)),
    ("utilities", 10, ("电费", "水费", "燃气", "天然气", "网上国网", "国家电网")),
    ("communication", 10, ("中国移动", "中国联通", "中国电信", "话费", "流量")),
    ("entertainment", 10, ("电影", "影院", "腾讯视频", "爱奇艺", "优酷", "哔哩哔哩", "steam", "游戏")),
    ("medical", 10, ("医院", "药房", "药店", "诊所", "体检", "胶囊", "医保", "门诊")),
    ("education", 10, ("学费", "培训", "教育", "书店", "图书")),
    ("clothing", 10, ("服饰", "服装", "优衣库", "耐克", "阿迪达斯")),
    ("travel", 10, ("携程", "去哪儿", "酒店", "民宿", "机票")),
    ("digital", 10, ("苹果", "华为", "小米")),
    ("express", 10, ("快递", "寄件", "物流", "菜鸟")),
    ("pet", 10, ("宠物", "猫", "狗")),
    ("fees", 30, ("手续费", "服务费", "逾期费", "违约金")),
    ("salary", 25, ("工资", "薪资")),
    ("bonus", 25, ("奖金", "年终奖")),
    ("investment-income", 25, ("利息", "结息", "收益")),
]
# rules of these categories are numbered together, as r-income-1 and on
RULE_NUMBERING = {"salary": "income", "bonus": "income", "investment-income": "income"}

# category -> (label, what it applies to)
CATEGORIES = {
    "food": ("餐饮", "expense"),
    "transport": ("交通", "expense"),
    "groceries": ("日用品", "expense"),
    "shopping": ("购物", "expense"),
    "housing": ("房租物业", "expense"),
    "utilities": ("水电燃气", "expense"),
    "communication": ("通讯", "expense"),
    "entertainment": ("娱乐", "expense"),
    "medical": ("医疗", "expense"),
    "education": ("教育", "expense"),
    "clothing": ("服饰", "expense"),
    "travel": ("旅行", "expense"),
    "digital": ("数码", "expense"),
    "express": ("快递物流", "expense"),
    "pet": ("宠物", "expense"),
    "fees": ("手续费利息", "expense"),
    "other": ("其他", "expense"),
    "salary": ("工资", "income"),
    "bonus": ("奖金", "income"),
    "investment-income": ("投资收益", "income"),
    "other-income": ("其他收入", "income"),
}
UNCATEGORISED = "未分类"
KIND_LABELS = {"expense": "支出", "income": "收入", "transfer-internal": "内部转账", "transfer-investment": "投资转账", "transfer-repayment": "还款", "refund": "退款", "unknown": "未知"}
