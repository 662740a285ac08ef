"""Relevance cases: which row comes first, which are among the first five, which must not lead.

Rows and cases are fixed values: the whole way from a catalog with readings and aliases to the final
lists has to give these results.
"""

import pytest

from seekstone.functions import readings
from seekstone.operators import catalog as C, evaluate, ranking, search as S

#: id, name, target, arguments, source (fixed values).
ROWS = [
    ("fx-chrome", "Google Chrome", r"C:\Program Files\Google\Chrome\Application\chrome.exe", None, "start-menu"),
    ("fx-chrome-remote", "Chrome Remote Desktop", r"C:\Program Files\Chrome Remote Desktop\crd.exe", None, "start-menu"),
    ("fx-vscode", "Visual Studio Code", r"C:\Users\dev\AppData\Local\Programs\Microsoft VS Code\Code.exe", None, "start-menu"),
    ("fx-vs", "Visual Studio", r"C:\Program Files\Microsoft Visual Studio\2022\Community\Common7\IDE\devenv.exe", None, "start-menu"),
    ("fx-wechat", "微信", r"C:\Program Files\Tencent\WeChat\WeChat.exe", None, "start-menu"),
    ("fx-wechat-dev", "微信开发者工具", r"C:\Program Files (x86)\Tencent\微信web开发者工具\wechatdevtools.exe", None, "start-menu"),
    ("fx-wecom", "企业微信", r"C:\Program Files\WXWork\WXWork.exe", None, "start-menu"),
    ("fx-idea", "IntelliJ IDEA", r"C:\Program Files\JetBrains\IntelliJ IDEA\bin\idea64.exe", None, "start-menu"),
    ("fx-notepad", "Notepad", r"C:\Windows\System32\notepad.exe", None, "start-menu"),
    ("fx-nemusic", "网易云音乐", r"C:\Program Files (x86)\Netease\CloudMusic\cloudmusic.exe", None, "start-menu"),
    ("fx-steam", "Steam", r"C:\Program Files (x86)\Steam\steam.exe", None, "start-menu"),
    ("fx-calc", "计算器", r"C:\Windows\System32\calc.exe", None, "start-menu"),
    ("fx-terminal", "Windows Terminal", r"C:\Users\dev\AppData\Local\Microsoft\WindowsApps\wt.exe", None, "start-menu"),
    ("fx-todo", "Microsoft To Do", r"C:\Program Files\WindowsApps\Microsoft.Todos\Todo.exe", None, "uwp"),
    ("fx-ndm", "Neat Download Manager", r"C:\Program Files\Neat Download Manager\NDM.exe", None, "start-menu"),
    ("fx-razer", "Razer Synapse", r"C:\Program Files (x86)\Razer\Synapse3\WPFUI\Framework\Razer Synapse 3\Razer Synapse.exe", None, "start-menu"),
    ("fx-xterminal", "XTerminal", r"C:\Program Files\XTerminal\XTerminal.exe", None, "start-menu"),
    ("fx-pwsh", "PowerShell", r"C:\Windows\System32\WindowsPowerShell\v1.0\powershell.exe", None, "start-menu"),
    ("fx-pwsh-dev", "Developer PowerShell", r"C:\Windows\System32\WindowsPowerShell\v1.0\powershell.exe", "-NoExit -Command Enter-VsDevShell", "start-menu"),
    ("fx-wps", "WPS Office", r"D:\Program Files\WPS Office\ksolaunch.exe", None, "start-menu"),
    ("fx-wps-raw", "wps", r"D:\Program Files\WPS Office\12.1.0\office6\wps.exe", None, "app-paths"),
    ("fx-regedit", "注册表编辑器", r"C:\Windows\regedit.exe", None, "start-menu"),
    ("fx-cmd", "命令提示符", r"C:\Windows\System32\cmd.exe", None, "start-menu"),
    ("fx-git-bash", "Git Bash", r"C:\Program Files\Git\git-bash.exe", None, "start-menu"),
    ("fx-notepadpp", "Notepad++", r"C:\Program Files\Notepad++\notepad++.exe", None, "start-menu"),
    ("fx-taskmgr", "任务管理器", r"C:\Windows\System32\Taskmgr.exe", None, "start-menu"),
    ("fx-control", "控制面板", "shell:::{26EE0668-A00A-4530-B89D-247C3C76FC01}", None, "builtin"),
    ("fx-recycle", "回收站", "shell:::{645FF040-5081-101B-9F08-00AA002F954E}", None, "builtin"),
    ("fx-alpine", "Alpine Tool", r"C:\Apps\Alpine\alpine.exe", None, "start-menu"),
    ("fx-albatross", "Albatross Tool", r"C:\Apps\Albatross\albatross.exe", None, "start-menu"),
    ("fx-zqx-early", "Zqx One", r"C:\Apps\Zqx\zqx.exe", None, "start-menu"),
    ("fx-zqx-late", "AAZqx One", r"C:\Apps\AAZqx\aazqx.exe", None, "start-menu"),
    ("fx-photoshop", "Adobe Photoshop", r"C:\Program Files\Adobe\Photoshop\Photoshop.exe", None, "start-menu"),
]
#: query, family, first, among the first five, must not lead (fixed values).
CASES = [
    ("chrome", "recall", "chrome", "chrome chrome-remote", ""), ("vis", "recall", "vs", "vs vscode", ""), ("微信", "recall", "wechat", "wechat wechat-dev wecom", ""),
    ("pad", "recall", "notepad", "notepad notepadpp", ""), ("n", "recall", "", "notepad", ""), ("z", "recall", "", "control", ""), ("nd", "recall", "", "ndm", ""),
    ("微信xin", "recall", "wechat", "wechat wechat-dev", ""), ("w微", "recall", "", "wechat", ""), ("weixin", "recall", "wechat", "wechat", ""), ("wx", "recall", "wechat", "wechat wechat-dev wecom", ""),
    ("todo", "recall", "todo", "todo", ""), ("to do", "recall", "todo", "todo", ""), ("visual code", "verify", "vscode", "vscode", ""), ("vs code", "verify", "vscode", "vscode", ""),
    ("ter", "verify", "xterminal", "xterminal terminal", ""), ("ndm", "verify", "ndm", "ndm", ""), ("vsc", "protection", "vscode", "vscode", ""), ("wt", "protection", "terminal", "terminal", ""),
    ("calc", "protection", "calc", "calc", ""), ("cmd", "protection", "cmd", "cmd", ""), ("idea", "protection", "idea", "idea", ""), ("ps", "protection", "photoshop", "photoshop", ""),
    ("gc", "protection", "chrome", "chrome", ""), ("雷蛇", "protection", "razer", "razer", ""), ("notepad", "protection", "notepad", "notepad notepadpp", "todo"),
    ("developer powershell", "protection", "pwsh-dev", "pwsh-dev", "pwsh"), ("wps", "protection", "wps", "wps", ""), ("to", "protection", "", "", "control recycle"), ("neat", "verify", "ndm", "ndm", ""),
    ("razer", "recall", "razer", "razer", ""), ("wangyiyun", "recall", "nemusic", "nemusic", ""), ("wyy", "recall", "", "nemusic", ""), ("jisuanqi", "recall", "calc", "calc", ""),
    ("kzmb", "recall", "control", "control", ""), ("hsz", "recall", "", "recycle", ""), ("zqx", "evidence", "zqx-early", "zqx-early zqx-late", ""), ("pad", "evidence", "notepad", "notepad", ""),
    ("chrome", "evidence", "chrome", "chrome chrome-remote", ""), ("al", "preference", "", "alpine albatross", ""), ("chorme", "verify", "", "chrome", ""), ("git", "recall", "", "git-bash", ""),
    ("regedit", "recall", "regedit", "regedit", ""), ("taskmgr", "recall", "", "taskmgr", ""), ("renwuguanliqi", "recall", "taskmgr", "taskmgr", ""), ("vs", "protection", "", "vs vscode", ""),
    ("code", "protection", "vscode", "vscode", ""), ("edge", "protection", "", "", "control recycle"), ("st", "protection", "", "steam", "control recycle"),
]
#: query, first, among the first five, must not lead; chosen before for it, launches, pins (fixed values).
WITH_HISTORY = [
    ("al", "albatross", "albatross alpine", "", {"albatross": 8}, {"albatross": 5}, []),
    ("al", "", "alpine albatross", "", {"alpine": 1}, {}, []),
    ("chrome", "chrome", "chrome", "chrome-remote", {"chrome-remote": 10}, {"chrome-remote": 80}, []),
    ("chrome", "chrome", "chrome", "chrome-remote", {}, {"chrome-remote": 30}, ["chrome-remote"]),
]
USED, NOW = 1_700_000_000, 1_700_086_400
#: Readings of the characters in the names (fixed values).
READINGS = "微 wei 信 xin 开 kai 发 fa 者 zhe 工 gong 具 ju 企 qi 业 ye 网 wang 易 yi 云 yun 音 yin 乐 yue 计 ji 算 suan 器 qi 注 zhu 册 ce 表 biao 编 bian 辑 ji 命 ming 令 ling 提 ti 示 shi 符 fu 任 ren 务 wu 管 guan 理 li 控 kong 制 zhi 面 mian 板 ban 回 hui 收 shou 站 zhan".split()
#: Other names of programs, and the part of a name that they stand for (fixed values).
ALIASES = {"vs": "visual studio", "chrome": "google chrome", "git": "git", "powershell": "powershell", "steam": "steam", "wps": "wps", "vsc": "visual studio code", "code": "visual studio code", "wt": "windows terminal", "calc": "计算器", "cmd": "命令提示符", "ps": "photoshop", "gc": "google chrome", "雷蛇": "razer", "regedit": "注册表编辑器", "taskmgr": "任务管理器"}


@pytest.fixture(scope="module")
def engine(spark):
    known = spark.createDataFrame([(c, [r]) for c, r in zip(READINGS[::2], READINGS[1::2])], "ch string, readings array<string>")
    rows = spark.createDataFrame(ROWS, "id string, name string, target string, args string, source string")
    catalog = S.enrich(readings.attach(rows, known)).cache()
    groups = C.launch_groups(catalog).cache()
    aliases = spark.createDataFrame([(a, None, t, True) for a, t in ALIASES.items()], "alias string, target_id string, target_name string, builtin boolean")

    def lists(queries, pairs=(), usage=(), pinned=()):
        table = lambda rows, schema: spark.createDataFrame(list(rows), schema)
        parsed = S.parse(table(enumerate(queries), "query_id int, text string"))
        hits = S.verify(S.candidates_of(catalog, parsed, aliases=aliases, scattered=True), scattered=True)
        total = sum(n for _, _, n in pairs)
        chosen = table([(q, i, n, n / total, USED) for q, i, n in pairs], "query string, item_id string, n long, share double, last_used long")
        used = table([(i, n, USED) for i, n in usage], "item_id string, launches long, last_used long")
        ids = lambda rows: table([(i,) for i in rows], "item_id string")
        return ranking.finish(hits, catalog, groups, chosen, used, ids(pinned), ids([]), ids([]), NOW)

    return lists


def wrong(ranked, first, among, not_first):
    """What a list gets wrong, as text."""
    name = lambda x: f"fx-{x}"
    out = []
    if first and ranked[:1] != [name(first)]:
        out.append(f"first is {ranked[:1]}, not {first}")
    out += [f"{x} is not in {ranked[:5]}" for x in among.split() if name(x) not in ranked[:5]]
    out += [f"{x} leads" for x in not_first.split() if ranked[:1] == [name(x)]]
    return out


def test_cases_without_history(spark, engine):
    shown = engine([c[0] for c in CASES]).cache()
    found = {k: [] for k in range(len(CASES))}
    for r in shown.orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["id"])
    faults = {(k, c[0]): w for k, c in enumerate(CASES) if (w := wrong(found[k], *c[2:]))}
    assert not faults, faults
    expected = spark.createDataFrame([(k, f"fx-{c[2]}", c[1]) for k, c in enumerate(CASES) if c[2]], "query_id int, id string, family string")
    for r in evaluate.metrics(shown, expected, ["family"]).collect():
        assert r["top1"] == r["recall_at_5"] == r["mrr"] == 1.0, r


def test_cases_with_history(engine):
    for query, first, among, not_first, chosen, launches, pins in WITH_HISTORY:
        shown = engine([query], [(query, f"fx-{i}", n) for i, n in chosen.items()], [(f"fx-{i}", n) for i, n in launches.items()], [f"fx-{i}" for i in pins])
        ranked = [r["id"] for r in shown.orderBy("rank").collect()]
        assert not wrong(ranked, first, among, not_first), (query, chosen, pins, ranked)
