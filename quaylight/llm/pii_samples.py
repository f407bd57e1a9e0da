"""Labelled sentences for fitting the personal-data model; all content is made up.

Each sentence is a frame with slots; a slot's text is drawn by a rule and carries its
label, or none for a look-alike.
"""

from __future__ import annotations

import random

from quaylight.llm.pii import Names, check_digit_ok

NAMES = Names(["欧阳", "司马", "上官", "Harborwick", "Linfield", "Stonemarsh"], ["子墨", "雨晴", "Alden", "Mirela", "Tobin"])
_OTHER_GIVEN = ["清和", "致远", "Quillon", "Bexley"]


def _word(r: random.Random) -> str:
    """Letters without meaning, so that no context of them is learned."""
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))


def _han(r: random.Random) -> str:
    return "".join(chr(r.randint(0x4E00, 0x8FFF)) for _ in range(3))


def _digits(r: random.Random, n: int, first: str = "0123456789") -> str:
    return r.choice(first) + "".join(r.choice("0123456789") for _ in range(n - 1))


def _id18(r: random.Random, good: bool) -> str:
    while True:
        d = _digits(r, 6, "123456") + f"{r.randint(1950, 2005)}{r.randint(1, 12):02}{r.randint(1, 28):02}" + _digits(r, 3)
        c = [x for x in "0123456789X" if check_digit_ok(d + x)][0]
        if not good:
            c = r.choice([x for x in "0123456789X" if x != c])
        s = r.choice(["", "", "-", " "])
        return f"{d[:6]}{s}{d[6:14]}{s}{d[14:]}{c}"


def _email(r: random.Random) -> str:
    local = "".join(r.choice("abcdefgh") for _ in range(6)) + r.choice(["", "12", ".x", "_y", "+tag"])
    dom, tld = r.choice(["web", "site", "firm"]), r.choice(["org", "net", "com", "io", "company", "center"])
    return r.choice([f"{local}@{dom}.{tld}", f"{local}@a.{dom}.{tld}", f"{local}＠{dom}.{tld}", f"{local}(at){dom}.{tld}", f"{local} [at] {dom} [dot] {tld}", f"{local} AT {dom} DOT {tld}", f"{local} @ {dom} . {tld}"])


def _phone(r: random.Random) -> str:
    a, b, c = "1" + r.choice("3578") + _digits(r, 1), _digits(r, 4), _digits(r, 4)
    x, y, z = _digits(r, 3, "23456789"), "555", _digits(r, 4)
    u = "7" + _digits(r, 3), _digits(r, 3), _digits(r, 3)
    return r.choice(
        [a + b + c, f"{a}-{b}-{c}", f"{a} {b} {c}", f"+86 {a}{b}{c}", f"0086 {a} {b} {c}", f"(+86){a}{b}{c}", f"+86-{a}-{b}-{c}", f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"1-{x}-{y}-{z}", f"{x}.{y}.{z}", f"+1 {x}-{y}-{z}", f"0{u[0]} {u[1]}{u[2]}", f"+44 {u[0]} {u[1]}{u[2]}", f"+44 (0){u[0]} {u[1]}{u[2]}"]
    )


def _address(r: random.Random) -> str:
    n, m, k = (r.randint(1, 900) for _ in range(3))
    if r.random() < 0.5:
        head = r.choice(["云川省平海市", "平海市", "平海市东湖区", "云川省平海市东湖区", "平海市长安县"])
        return head + r.choice(["春熙路", "解放大道", "柳树巷", "建国北路", "槐花街"]) + r.choice([f"{n}号", f"{n}号{m % 30 + 1}栋", f"{n}号-{m % 9 + 1}号", f"{n}号{m % 9 + 1}号楼{k}室", f"{n}号{m % 9 + 1}单元{k}室"])
    return f"{n}{r.choice(['', 'A'])} {r.choice(['Willow', 'Maple Grove', 'Old Harbor'])} {r.choice(['Street', 'Road', 'Ave.', 'Lane', 'Close'])}{r.choice(['', ', Apt 3B', ', Unit 12'])}, {r.choice(['Fernley', 'Port Ashby'])} {10000 + n * 37}"


def _han_name(r: random.Random) -> str:
    return r.choice(["欧阳", "司马", "上官"]) + r.choice(["子墨", "雨晴", "清和", "致远"])


def _latin_name(r: random.Random) -> str:
    g, f = r.choice(["Alden", "Mirela", "Tobin", "Quillon", "Bexley"]), r.choice(["Harborwick", "Linfield", "Stonemarsh"])
    i = r.choice("ABKTR") + "."
    return r.choice([f"{g} {f}", f"{g} {f}", f"{g} {i} {f}", f"{i} {f}", f"{f}, {g}"])


_HAN_FRAMES = {
    "EMAIL": ["邮件请寄往{}谢谢", "我的信箱是{}，欢迎来信。", "附件已转给{}了。", "客服信箱 {}"],
    "PHONE": ["手机号：{}。", "请拨打{}咨询。", "热线 {} 全天有人。", "有急事联系我{}！", "微信和手机都是{}，", "加我 {} 细说。", "她的号码是{}。", "给{}发消息就行。"],
    "ID_NUMBER": ["公民身份号码{}，已核验。", "登记用的身份证是{}。", "社保号 {} 已录入。", "附证件号码：{}。"],
    "ADDRESS": ["门店位于{}，周一休息。", "请送到{}前台。", "家住{}。", "公司搬去了{}！", "会场：{}。", "收货地址是{}，谢谢。", "仓库设于{}旁边。", "户籍所在地为{}。", "从{}出发。", "快递发往 {} 就好。"],
    "NAME": ["作者：{}。", "负责人是{}，有事问。", "请联系{}。", "昨天{}女士来过。", "{}教授的讲座改期了。", "由{}主持会议。", "感谢{}的帮助。", "签名：{}", "我和{}一起去。", "（转自{}）", "「{}」已加入", "听{}说过这件事。", "{}先生来电了。", "{}老师的课很满。", "{}经理批准了。", "{}博士到场。", "{}小姐留言。", "【{}】发言：", "与会者有{}、", "问 {} 就行。", "见 {} 一面。", "{}", "{}", "{}", "{}", "{} (店长)", "{} / 值班", "{}（助教）", "{} 13900139000", "{} +86 139 0013 9000", "{} 202-555-0143"],
}
_LATIN_FRAMES = {
    "EMAIL": ["Reach me under {} any time.", "Mail {} for details.", "The address {} bounced."],
    "PHONE": ["Mobile: {}, evenings only.", "You can ring {} at noon.", "Text me on {}.", "Tel. {}", "Dial {} now.", "Telephone {} for help.", "Reachable under {}."],
    "ID_NUMBER": ["Social security number {} was verified.", "Identity card: {}.", "Passport holder's number is {}."],
    "ADDRESS": ["Our office is {}, ground floor.", "Deliver to {} today.", "She lives at {}.", "Visit us: {}."],
    "NAME": ["Written by {} last year.", "Please talk to {} first.", "Regards, {}", "{} joined the call.", "Professor {} agreed.", "Mr. {} signed the form.", "according to {}, it works.", "{}", "{}", "{}", "{} xyz@mail.org", "{} / owner", "The award goes to {}."],
}
_TRAPS = [
    lambda r: f"快件{_digits(r, 10, '6789')}正在派送。", lambda r: f"Tracking {_digits(r, 10, '6789')} was delivered.", lambda r: f"编码 {_digits(r, 20, '3')} 已失效。", lambda r: f"桌号 {_digits(r, 4)}-{_digits(r, 4)}。", lambda r: f"工单{_digits(r, 10, '6789')}已关闭。",
    lambda r: f"固件升到 {r.randint(1, 99)}.{r.randint(1, 99)}.{r.randint(1, 99)} 就好。", lambda r: f"网关是 172.{r.randint(16, 31)}.{r.randint(1, 99)}.{r.randint(1, 99)}。", lambda r: f"交易码 {_id18(r, False)} 无效。", lambda r: f"Batch {_id18(r, False)} failed.", lambda r: f"Job {_digits(r, 10, '6789')} is queued.",
    lambda r: "欧阳会的人都走了。", lambda r: "上官有两个版本。", lambda r: "司马和他都不在。", lambda r: "欧阳在楼下。", lambda r: "上官说的对。", lambda r: "司马把票退了。", lambda r: "听说欧阳的车坏了。", lambda r: "柳树巷附近很堵。", lambda r: "从解放大道走更快。", lambda r: f"On 2023-{r.randint(1, 12):02}-19 we moved.", lambda r: "@someone 请看公告", lambda r: "Ping @tobin later.",
    lambda r: "Mrs. Linfield left early.", lambda r: "We met Linfield there.", lambda r: "A Harborwick spokesman declined.", lambda r: "The Stonemarsh office moved.", lambda r: f"售价 {r.randint(1000, 99999)} 元。", lambda r: f"Commit {_digits(r, 8)}ee broke it.", lambda r: f"Case {_digits(r, 10, '6789')} reopened.",
    lambda r: f"{_word(r)} {_digits(r, 10, '23456789')} {_word(r)}.", lambda r: f"{_han(r)}{_digits(r, 10, '23456789')}{_han(r)}。", lambda r: f"{_word(r)} {_digits(r, 10, '23456789')} {_word(r)}.", lambda r: f"{_han(r)} {_digits(r, 10, '23456789')} {_han(r)}。",
]


def labelled(n: int = 1800, seed: int = 5, frames: tuple[dict, dict] | None = None) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Texts with their labelled segments (start, end, kind), by the frames of this module or others (Chinese, English)."""
    r = random.Random(seed)
    han_frames, latin_frames = frames or (_HAN_FRAMES, _LATIN_FRAMES)
    out = []
    for _ in range(n):
        text, gold = "", set()
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.4:
                text += r.choice(_TRAPS)(r)
            else:
                kind = r.choice(list(han_frames))
                han = r.random() < 0.5
                if kind == "NAME":
                    item = _han_name(r) if han else _latin_name(r)
                elif kind == "ID_NUMBER":
                    item = _id18(r, True) if r.random() < 0.6 else "-".join([_digits(r, 3), _digits(r, 2), _digits(r, 4)])
                else:
                    item = {"EMAIL": _email, "PHONE": _phone, "ADDRESS": _address}[kind](r)
                frame = r.choice((han_frames if han else latin_frames)[kind])
                if frame[0] != "{" or len(frame) > 24 or not text:
                    pre, post = frame.split("{}")
                    if "139" in post or "555" in post:
                        gold.add((len(item) + 1, len(item) + len(post), "PHONE"))
                    if "xyz@" in post:
                        gold.add((len(item) + 1, len(item) + len(post), "EMAIL"))
                    gold.add((len(text) + len(pre), len(text) + len(pre) + len(item), kind))
                    text += pre + item + post
                    if frame[0] == "{" and len(text) == len(item + post) and r.random() < 0.8:
                        break  # a name that fills its field
            text += r.choice([" ", "\n", ""])
        out.append((text, gold))
    return out
