"""Synthetic records with known groups: everybody's talk and six patterns that the signals should tell from it."""

from __future__ import annotations

import datetime
import random
from collections.abc import Iterator
from typing import Any

BASE_TIME = datetime.datetime(2026, 9, 1, 12, tzinfo=datetime.timezone.utc)
SEED = 20261003
_SUBJECTS = "昨晚那场比赛 新开的面馆 阳台上的番茄 这本旧小说 楼下的修车摊 周末的徒步路线 孩子的科学作业 老家的梅雨 公司的食堂 这张黑胶唱片 河边的跑道 奶奶做的酱菜 二手的相机 夜班的公交 山里的民宿 地铁口的花店 桌上的机械钟 冬天的暖气 邻居家的猫 海边的灯塔".split()
_VERBS = "让我想起小时候的夏天 比预想的要安静许多 其实花不了多少钱 一到下雨就变了样子 得提前两天去打听 连着三年都没有换过 适合一个人慢慢看 总在傍晚最好看 要是早点知道就好了 看着简单做着费劲 跟照片上不太像 每次都有新的发现 朋友听了都不相信 修好以后又用了很久 背后有个挺长的故事 谁路过都要停一停 价格这几年涨得快 味道还是原来那样 细节比我记得的多 白天和晚上两个模样".split()
_ENDINGS = "改天再去一趟 有空的话写写经过 想听听别人怎么看 照片回头补上 就先说到这里 下次带家里人来 也许是我记错了 明年再比较一次 路上注意安全 天气好的时候再说".split()
_PRAISE = "本地商家的新款水杯质量超出预期保温一整天都不凉"
_CHEERS = ["讲得真好", "说到心里去了", "就是这个理", "太赞同了", "必须顶", "一针见血", "同感同感", "说得实在", "没毛病", "为你点赞"]
_OFFERS = ["要资料的加薇❤️信慢慢说", "名额不多 加溦信 我来安排", "有货 加➕微➕信 看图", "想入门就私❤️聊❤️我 带你", "老客户都知道 拉你进裙 有优惠"]
_REPEATED = ["这家店的早餐我吃了半年从来没有失望过", "每天坚持二十分钟一个月就能看到变化", "换了这个牌子以后再也没有坏过一次"]
_FLOODS = ["真香" * 14, "快来看看这里快来看看" * 4, "啊" * 24]


def _actor(rng: random.Random, name: str, real: bool) -> dict[str, Any]:
    days = rng.randint(200, 2000) if real else rng.randint(1, 12)
    return {
        "actor_id": name,
        "actor_name": f"朋友{rng.randint(1, 9999)}" if real else f"用户{rng.randint(10**6, 10**7 - 1)}",
        "actor_created_at": (BASE_TIME - datetime.timedelta(days=days)).isoformat(),
        "actor_followers": rng.randint(5, 800) if real else 0,
        "actor_following": rng.randint(10, 400) if real else rng.randint(200, 900),
        "actor_posts": rng.randint(20, 900) if real else rng.randint(1, 6),
        "actor_has_avatar": real,
        "actor_default_name": not real,
    }


def _posts(rng: random.Random) -> Iterator[tuple[str, dict[str, Any], str, float, str]]:
    """(group, actor, topic, seconds after BASE_TIME, text) of each record."""
    # no two texts share a subject and what is said of it, or that and an ending: they aren't copies
    tails = [(v, e) for v in _VERBS for e in _ENDINGS]
    rng.shuffle(tails)
    seen = {v: rng.sample(_SUBJECTS, len(_SUBJECTS)) for v in _VERBS}
    talk = [f"{seen[v].pop()}，{v}，{e}" for v, e in tails]
    fake = lambda group, i: _actor(rng, f"fake-{group}-{i:02d}", False)
    for i in range(120):
        yield "normal", _actor(rng, f"u-{i:04d}", True), f"video-{rng.randint(1000, 1002)}", rng.uniform(0, 3 * 3600), talk.pop()
    for i in range(8):  # one text with small changes, far apart in time
        yield "template", fake("tpl", i), "video-1001", 3600 + 900 * i, _PRAISE + ("", "了", "。", "！", "哦", "呢", "啊", "~")[i]
    for i in range(15):  # a crowd within three minutes
        yield "burst", fake("burst", i), "video-1002", 7200 + 11 * i, rng.choice(_CHEERS) + "！" * rng.randint(0, 2)
    gang = [fake("gang", i) for i in range(6)]
    for t in range(4):  # the same few in the same topics
        for i, actor in enumerate(gang):
            yield "gang", actor, f"video-{1003 + t}", 4000 + 900 * t + 40 * i, talk.pop()
    for i, text in enumerate(_OFFERS):  # contacts written so that filters miss them
        yield "shill", fake("shill", i), "video-1007", 9000 + 300 * i, text
    for i, text in enumerate(_REPEATED):  # accounts that say one thing only
        actor = fake("repeat", i)
        for k in range(6):
            yield "repeat", actor, "video-1008", 10000 + 600 * i + 90 * k, text
    for i, text in enumerate(_FLOODS):  # texts that repeat within
        yield "flood", fake("flood", i), "video-1009", 11000 + 120 * i, text


def records(seed: int = SEED) -> list[dict[str, Any]]:
    """193 records by 160 accounts in 10 topics, with labels is_synthetic_positive and group."""
    return [
        {"item_id": f"c-{n:05d}", "text": text, "topic": topic, "created_at": (BASE_TIME + datetime.timedelta(seconds=seconds)).isoformat(), "is_synthetic_positive": group != "normal", "group": group, **actor}
        for n, (group, actor, topic, seconds, text) in enumerate(_posts(random.Random(seed)), 1)
    ]
