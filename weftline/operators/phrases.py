"""Rule tables for Chinese copy: wording that talks about its sources, worn phrases by category, and signs of a template.

They go with :func:`~weftline.operators.rules.lint`, :func:`~weftline.operators.rules.category_counts` and
:func:`~weftline.operators.rules.template_score`. A gap in a phrase stays within a sentence.
"""

from __future__ import annotations

from weftline.operators.rules import Rule

GAP = "[^。！？!?\n]*?"

# Copy for an audience must not speak of the material it was made from. The order is the priority.
SOURCE_TALK = [
    Rule("original-material-wording", "source-talk", "素材中的原始说法", 1),
    Rule("provided-material", "source-talk", "(?:根据|依据)用户提供的素材", 2),
    Rule("material-shows", "source-talk", "从(?:这些|这份|用户提供的)?素材(?:中)?(?:可以)?(?:看出|看到)", 3),
    Rule("showing-material", "source-talk", "这里展示的是(?:用户提供的|原始)?素材", 4),
    Rule("material-says", "source-talk", "(?:原始)?素材(?:中|里)(?:说|提到|显示|表示)", 5),
    Rule("generic-web-research", "source-talk", "(?:根据|依据)(?:网上资料|网络资料|检索结果|搜索结果)", 6),
    Rule("research-shows", "source-talk", "(?:网上资料|网络资料|检索结果|搜索结果)(?:中)?(?:可以)?(?:看出|看到|显示|表明)", 7),
    Rule("generic-material-attribution", "source-talk", "(?:原始|用户提供的)?素材(?:中|里)?(?:给出(?:的)?|显示|表明)", 8),
]

# Worn phrases by category; … is a gap.
PHRASES = {
    "opener": ["在当今时代", "随着社会的发展", "在信息化快速发展的今天", "近年来，越来越多的人开始关注", "不可否认的是", "众所周知", "值得注意的是"],
    "connector": ["首先…其次…最后", "一方面…另一方面", "不仅…更", "既…又", "与此同时", "从某种程度上来说"],
    "ending": ["这不仅是…更是", "具有重要意义", "为我们提供了新的思考", "值得我们深入探索", "未来仍有很大发展空间", "让我们共同期待"],
    "false-empathy": ["我完全理解你的感受", "这确实是一个很重要的问题", "你的担心是很有道理的", "面对这种情况，我们可以从以下几个方面考虑"],
    "vague-value": ["赋能", "闭环", "抓手", "沉淀", "打造", "提效", "生态", "矩阵", "链路", "价值", "体验", "维度", "路径"],
    "platform-template": ["干货满满", "建议收藏", "看完你就懂了", "真的绝了", "狠狠拿捏", "普通人一定要知道", "不允许还有人不知道"],
}
# Office jargon, beside the vague words.
OFFICE = ["赋能", "闭环", "抓手", "沉淀", "打造", "推进", "持续优化"]

# Signs of a template; three different ones make a text look like one.
TEMPLATE_SIGNS = {
    "counter-title": "不是…，而是",
    "stock-opening": "看完…我最大的感受是",
    "tidy-points": "我整理了",
    "uniform-heading": "不是…，是",
    "ordinary-people": "普通人最该学的是",
    "closing-questions": "这是我的主线吗",
    "golden-ending": "真正拉开差距的，可能不是…而是",
}


def _rules(category: str, phrases: dict[str, str]) -> list[Rule]:
    return [Rule(name, category, phrase.replace("…", GAP)) for name, phrase in phrases.items()]


def phrase_rules() -> list[Rule]:
    """One rule a phrase, named by the phrase itself."""
    return [rule for category, phrases in PHRASES.items() for rule in _rules(category, {p: p for p in phrases})]


def office_rules() -> list[Rule]:
    return _rules("office", {p: p for p in OFFICE})


def template_rules() -> list[Rule]:
    """Signs of a template. Points and questions are told by their fixed part: 我整理了 needs a number behind it."""
    signs = TEMPLATE_SIGNS | {"tidy-points": TEMPLATE_SIGNS["tidy-points"] + r"\s*[0-9一二三四五六七八九十两几]+\s*个"}
    return _rules("template", signs)
