"""Packs: fields, sections, rules and wording as data. ``contract`` is for Chinese contracts, ``corpus`` for prose."""

from __future__ import annotations

from docsieve.operators.extract import Field, Pack
from docsieve.operators.review import Phrases
from docsieve.operators.rules import Rule, Wording

# fixed values: labels, keywords, patterns and wording of the contract domain
CONTRACT = Pack(
    fields=(
        Field("contract_title", "title_suffix", kind="block", pattern=r"(?:合同|协议)$"),
        Field("contract_number", "regex_label", pattern=r"(?:合同编号|合同号|编号)\s*[：:]\s*([A-Za-z0-9_-]+)"),
        Field("signing_party", "regex_label", pattern=r"甲方\s*[：:]\s*(.+)"),
        Field("counterparty", "regex_label", pattern=r"乙方\s*[：:]\s*(.+)"),
        Field("amount", "regex_amount", pattern=r"(?:合同总金额|合同金额|总金额|金额)[^0-9]{0,20}([0-9][0-9,]*(?:\.[0-9]+)?)", after="number"),
        Field("currency", "currency_keyword", kind="keywords", values={"CNY": ["人民币", "CNY", "RMB", "￥", "¥"], "USD": ["美元", "USD", "US$"]}, gates=("金额", "价款", "费用")),
        Field("effective_date", "regex_date", pattern=r"(?:生效日期|有效期自)\s*[：:]\s*(\d{4}(?:年|-|/)\d{1,2}(?:月|-|/)\d{1,2}日?)", after="date"),
        Field("expiry_date", "regex_date", pattern=r"(?:到期日期|有效期至)\s*[：:]\s*(\d{4}(?:年|-|/)\d{1,2}(?:月|-|/)\d{1,2}日?)", after="date"),
    ),
    sections={
        "payment_clause": ["付款条款", "付款方式"],
        "delivery_clause": ["交付条款", "交货条款"],
        "acceptance_clause": ["验收条款", "验收标准"],
        "breach_clause": ["违约条款", "违约责任"],
        "confidentiality_clause": ["保密条款", "保密义务"],
        "data_clause": ["数据条款", "数据保护", "数据处理"],
        "intellectual_property_clause": ["知识产权条款", "知识产权"],
        "dispute_resolution_clause": ["争议解决条款", "争议解决"],
    },
    numbered=r"第[^\s]{1,8}条",
)
# fixed values of the contract domain
CONTRACT_METRICS = {
    "prepayment_ratio": r"(?:预付款(?:比例)?(?:为|[:：])?\s*(\d+(?:\.\d+)?)\s*%|(\d+(?:\.\d+)?)\s*%\s*(?:的)?预付款)",
    "payment_period_days": r"(?:付款|支付|款项)[^。；\n]{0,40}?(\d+)\s*(?:个)?(?:自然日|工作日|日|天)|(\d+)\s*(?:个)?(?:自然日|工作日|日|天)[^。；\n]{0,20}?(?:付款|支付|款项)",
}
# fixed values of the contract domain
CONTRACT_WORDING = Wording("字段应可明确提取", "不高于 ", {"percent": "%", "days": "天"})
# fixed values of the contract domain
MAIN_KEYWORDS = ("合同", "协议", "contract", "agreement")
# fixed values of the contract domain
FILE_TYPES = ("pdf", "docx", "jpg", "jpeg", "png")


def _missing(*paths: str, message: str) -> dict:
    return {"fields": list(paths), "trigger": "any", "hit_message": message}


# fixed values of the contract domain
CONTRACT_RULES = (
    Rule(1, "SUBJECT_INFO_MISSING", "合同主体信息缺失", "high", "field_missing", _missing("basic_info.signing_party", "basic_info.counterparty", message="未提取到甲方或乙方信息"), "请补充并核对合同双方的完整法定名称。"),
    Rule(2, "AMOUNT_MISSING", "合同金额缺失", "medium", "field_missing", _missing("basic_info.amount", message="未提取到合同金额"), "请明确合同总金额及计价口径。"),
    Rule(3, "CONFIDENTIALITY_MISSING", "保密条款缺失", "medium", "field_missing", _missing("clauses.confidentiality_clause", message="未提取到保密条款"), "建议补充保密范围、期限及违约责任。"),
    Rule(4, "ACCEPTANCE_STANDARD_MISSING", "验收条款缺失", "medium", "field_missing", _missing("clauses.acceptance_clause", message="未提取到验收条款"), "建议明确验收标准、期限和不通过后的处理方式。"),
    Rule(5, "PAYMENT_TERM_MISSING", "付款条款缺失", "medium", "field_missing", _missing("clauses.payment_clause", message="未提取到付款条款"), "建议明确付款节点、比例、期限和前置条件。"),
    Rule(6, "PREPAYMENT_RATIO_HIGH", "预付款比例过高", "high", "numeric_threshold", {"field": "clauses.payment_clause", "metric": "prepayment_ratio", "operator": "gt", "threshold": 50, "unit": "percent", "hit_message": "预付款比例高于 50%"}, "建议降低预付款比例或增加履约担保与付款条件。"),
    Rule(7, "PAYMENT_PERIOD_LONG", "付款周期过长", "medium", "numeric_threshold", {"field": "clauses.payment_clause", "metric": "payment_period_days", "operator": "gt", "threshold": 60, "unit": "days", "hit_message": "付款周期超过 60 天"}, "建议确认长付款周期的资金占用影响并协商缩短。"),
    Rule(8, "AUTO_RENEWAL_PRESENT", "存在自动续约约定", "medium", "keyword", {"fields": [f"clauses.{c}" for c in CONTRACT.sections], "keywords": ["自动续约", "自动延长", "自动顺延"], "hit_message": "发现自动续约或自动延长表达"}, "建议核对自动续约期限、通知窗口和退出条件。"),
    Rule(9, "DISPUTE_JURISDICTION_PRESENT", "争议管辖信息已识别", "low", "presence", {"fields": ["clauses.dispute_resolution_clause"], "keywords": ["人民法院", "管辖", "仲裁委员会"], "hit_message": "已识别明确的争议解决机构或管辖表达"}, "请结合双方所在地和履约成本人工确认该管辖约定是否有利。"),
    Rule(10, "BREACH_LIABILITY_IMBALANCE", "违约责任明显单方失衡", "high", "llm_semantic", {"target_clause": "breach_clause"}, "建议人工核对双方违约责任、责任上限和免责范围是否对等。"),
    Rule(11, "IP_OWNERSHIP_RISK", "知识产权归属需重点确认", "high", "llm_semantic", {"target_clause": "intellectual_property_clause"}, "建议人工确认既有知识产权、交付成果权属及授权范围。"),
    Rule(12, "DATA_PROCESSING_RISK", "数据处理责任需重点确认", "high", "llm_semantic", {"target_clause": "data_clause"}, "建议人工确认数据用途、保存期限、第三方共享及安全责任边界。"),
    Rule(13, "DISPUTE_RESOLUTION_RISK", "特殊争议解决约定需确认", "medium", "llm_semantic", {"target_clause": "dispute_resolution_clause"}, "建议人工评估约定机构、地点、适用规则及争议处理成本。"),
)
# fixed values of the contract domain
CONTRACT_PHRASES = Phrases(
    no_hits="本合同未命中当前确定性风险规则，整体风险等级为低。",
    summary="本合同共命中 {n} 条风险规则，其中高风险 {high} 条、中风险 {medium} 条、低风险 {low} 条。建议重点关注{names}。",
    names_joiner="、",
    title="合同审查结果：{level}",
    levels={"high": "高风险", "medium": "中风险", "low": "低风险"},
    nothing="当前确定性规则未发现明确风险，请继续进行人工审批复核。",
    focus="重点关注：",
    suggestions="建议：",
)

CORPUS = Pack(
    fields=(
        Field("email", "regex", pattern=r"([A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+)"),
        Field("address", "regex", pattern=r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"),
        Field("license", "regex", pattern=r"[Ll]icensed under (?:the )?([A-Z][A-Za-z -]*[A-Za-z])"),
        Field("opening", "regex", pattern=r"^([A-Z][a-z]+)"),
    ),
    sections={"the_part": ["The "], "of_part": ["Of "], "and_part": ["And "]},
)
#: Rules with every mode and status, for the result tables: (rule_id, rule_code, risk_level, rule_status, match_mode, rule_version).
LADDER_RULES = (
    (1, "R1", "high", "active", "field_missing", "1.0"), (2, "R2", "medium", "active", "numeric_threshold", "1.0"), (3, "R3", "low", "inactive", "keyword", "1.0"), (4, "R4", "medium", "active", "presence", "1.0"),
    (5, "R5", "low", "active", "future_llm", "1.0"), (6, "R6", "high", "active", "llm_semantic", "1.0"), (7, "R7", "medium", "active", "llm_semantic", "1.0"),
)
CORPUS_METRICS = {"version": r"(?:[Vv]ersion ([0-9]+(?:\.[0-9]+)?)|BY-NC ([0-9]+(?:\.[0-9]+)?))"}
CORPUS_WORDING = Wording("a clear value", "at most ", {})
CORPUS_RULES = (
    Rule(1, "NO_LICENSE", "no license line", "medium", "field_missing", {"fields": ["basic_info.license"], "trigger": "any", "hit_message": "no license found"}, "Find the license."),
    Rule(2, "NO_PARTS", "no parts", "low", "field_missing", {"fields": ["clauses.the_part", "clauses.of_part"], "trigger": "all", "hit_message": "neither part found"}, "Read the text."),
    Rule(3, "NEW_LICENSE", "late license version", "medium", "numeric_threshold", {"field": "basic_info.license", "metric": "version", "operator": "gt", "threshold": 2.5, "hit_message": "late version"}, "Check the version."),
    Rule(4, "CONTACT", "contact data", "high", "presence", {"fields": ["basic_info.email", "basic_info.address"], "keywords": ["@mail5", "@", "."], "hit_message": "contact data found"}, "Remove it."),
    Rule(5, "STOP_WORDS", "common words in a part", "low", "keyword", {"fields": ["clauses.the_part", "clauses.of_part", "clauses.and_part"], "keywords": ["stupid", "erthe", "thing"], "hit_message": "words found"}, "None."),
)
CORPUS_PHRASES = Phrases(
    no_hits="no rule hit, risk low",
    summary="{n} hits: {high} high, {medium} medium, {low} low; first {names}",
    names_joiner=", ",
    title="review: {level}",
    levels={"high": "high", "medium": "medium", "low": "low"},
    nothing="nothing found",
    focus="focus:",
    suggestions="advice:",
    line="{i}. {a}: {b}",
)
