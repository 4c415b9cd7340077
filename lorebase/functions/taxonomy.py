"""Categories, keywords and boosts. A taxonomy is a parameter of every function
that classifies; ``DEFAULT`` is a small one. ``Taxonomy.of_rows`` makes one from a table."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Category slugs in order of precedence among equal scores (fixed values).
CATEGORIES = (
    "ai-agents", "coding", "evals", "models", "product-ideas", "design", "infra", "papers", "workflows", "tools", "prompts",
    "business", "security", "data", "robotics", "voice-audio", "vision", "browser-automation", "local-first", "open-source", "misc",
)
#: Points for a category by domain of a link (fixed values).
BOOSTS = {
    "github.com": {"coding": 3, "tools": 2, "open-source": 2},
    "arxiv.org": {"papers": 4, "models": 2, "evals": 1},
    "huggingface.co": {"models": 3, "tools": 2, "papers": 1},
    "twitter.com": {"misc": -1},
    "x.com": {"misc": -1},
}
#: Categories whose clusters give project ideas, and for whom (fixed values).
AUDIENCES = {
    "ai-agents": "Developers building autonomous agents and AI workflows",
    "coding": "Software engineers and developers",
    "product-ideas": "Indie hackers and builders",
    "tools": "Developers and power users",
    "infra": "DevOps engineers and platform teams",
    "workflows": "Operations teams and productivity-focused individuals",
    "business": "Founders and business development professionals",
    "design": "Designers and frontend developers",
}
_KEYWORDS = {
    "ai-agents": "agent, tool use, automation, mcp, autonomous",
    "coding": "code, python, rust, typescript, refactor, debug, compiler",
    "evals": "eval, benchmark, leaderboard, test set, mmlu",
    "models": "model, llm, gpt, claude, llama, fine-tune, inference",
    "product-ideas": "startup idea, product, feature, prototype",
    "design": "design, ui, ux, figma, typography",
    "infra": "kubernetes, docker, latency, gpu, deploy, cluster",
    "papers": "paper, arxiv, research, theorem",
    "workflows": "workflow, pipeline, process, playbook",
    "tools": "tool, cli, plugin, library, app",
    "prompts": "prompt, system prompt, few-shot, instruction",
    "business": "business, pricing, revenue, market, sales",
    "security": "security, vulnerability, exploit, encryption",
    "data": "data, dataset, database, sql, analytics",
    "robotics": "robot, drone, actuator",
    "voice-audio": "voice, speech, audio, transcription, tts",
    "vision": "vision, image, video, ocr",
    "browser-automation": "browser automation, scraper, playwright, crawl",
    "local-first": "local-first, offline, sync, crdt",
    "open-source": "open source, license, fork, maintainer",
}


@dataclass(frozen=True)
class Taxonomy:
    categories: tuple[str, ...]
    keywords: dict[str, tuple[str, ...]]
    boosts: dict[str, dict[str, float]] = field(default_factory=lambda: BOOSTS)

    @classmethod
    def of_rows(cls, rows, boosts=None) -> Taxonomy:
        """From (category, keyword) pairs; keywords are lower-cased."""
        keywords: dict[str, list[str]] = {}
        for category, keyword in rows:
            keywords.setdefault(category, []).append(keyword.lower())
        known = tuple(c for c in CATEGORIES if c != "misc")
        order = known + tuple(c for c in keywords if c not in known and c != "misc") + ("misc",)
        return cls(order, {c: tuple(k) for c, k in keywords.items()}, BOOSTS if boosts is None else boosts)

    def weights(self) -> list[tuple[int, str, str, float]]:
        """(category's place, category, keyword, weight): two points for a keyword with a blank."""
        return [(i, c, k, 2.0 if " " in k else 1.0) for i, c in enumerate(self.categories) for k in self.keywords.get(c, ())]


DEFAULT = Taxonomy.of_rows([(c, k.strip()) for c, ks in _KEYWORDS.items() for k in ks.split(",")])


def label(slug: str) -> str:
    special = {"ai-agents": "AI Agents", "voice-audio": "Voice/Audio", "local-first": "Local-First"}
    return special.get(slug, slug.replace("-", " ").title())
