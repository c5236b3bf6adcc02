"""They must equal those of the engine whose results this one matches."""

STOP_WORDS = (
    "the and for with this that from into when how what add adding implement implementation support using use create make do does should need needs want wants "
    "a an are is be by of to in on at it its our your we you them their back again also just about have has had will would can could new some all any not please "
    "code if then else where there here up down over out under through than as which while each more most other such only own same so too very"
).split()
FRAMEWORK_DIRECTORIES = (
    "auth api models services service repositories repository routes pages components controllers middleware handlers views templates migrations schema database db store "
    "plugins providers config types schemas dto domain core infra infrastructure internal webhooks events jobs workers lib utils util helpers test tests"
).split()
LANGUAGE_OF = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "pyw": "python", "rs": "rust", "go": "go"}
PROBED_ENDINGS = "ts tsx mts cts js jsx mjs cjs py pyi rs go".split()
PROBED_BASES = "index mod __init__".split()
EXCLUDED = "node_modules target .git .ctx dist build .cache vendor coverage __pycache__ .next .nuxt .venv venv .venvs env .env Pods .output".split()
MAX_FILE_SIZE, MAX_TOKENS, MAX_FILES, MOST_FOLLOWED, MOST_DEPENDENCIES, MOST_KEYWORDS = 2 * 1024 * 1024, 12_000, 25, 6, 12, 40
SYNONYMS = [
    group.split()
    for group in """
login signin sign_in sign-in authenticate authentication auth
signup sign_up sign-up register registration
password passwd passcode credential secret
email mail mailbox
avatar picture photo image thumbnail
profile account userprofile
rate ratelimit rate_limiting throttle limit
tier plan subscription membership level
billing invoice charge checkout
payment payments checkout charge
webhook callback hook eventlistener
audit log history trail activity
preferences prefs settings options config
notification alert notify notifications
admin administrator staff permission role
export download dump serialize extract
import load ingest parse
reset regenerate reissue recover revoke
verify verification confirm validate check
metrics stats analytics counts report
dashboard overview report home
upload store put save persist
session token jwt authtoken
user account member person
data record entity info information
config configuration settings options
refund reversal chargeback
search query find lookup
changed modified updated diff
delete remove drop destroy purge
error exception failure fault
test tests spec unittest
""".strip().split("\n")
]
NAME_POINTS = {3: 6.0, 2: 3.0, 1: 2.0}
ROOT_SCORE, HUB_DEPENDENTS, FOLLOW_BASE, FOLLOW_SHARE, RECENT, CHANGED = 3.0, 40, 2.0, 0.1, 2.0, 1.5
#: Packages that name a framework, in the order in which they are looked for, and files that name a package manager.
FRAMEWORKS = {
    "next": "Next.js", "nuxt": "Nuxt", "remix": "Remix", "gatsby": "gatsby", "svelte": "SvelteKit", "angular": "Angular", "vue": "Vue", "react": "React", "@nestjs/core": "NestJS",
    "express": "Express", "fastify": "Fastify", "koa": "Koa", "graphql": "GraphQL", "prisma": "Prisma", "drizzle-orm": "Drizzle ORM", "tailwindcss": "Tailwind CSS", "vitest": "Vitest", "jest": "Jest",
}
CARGO_FRAMEWORKS = {"actix-web": "Actix Web", "axum": "Axum", "rocket": "Rocket", "tokio": "Tokio", "serde": "Serde", "clap": "Clap"}
PACKAGE_MANAGERS = {
    "pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "package-lock.json": "npm", "bun.lockb": "bun", "bun.lock": "bun", "uv.lock": "uv", "poetry.lock": "poetry", "Cargo.lock": "cargo", "go.sum": "go modules",
}
LANGUAGE_NAMES = {"typescript": "TypeScript", "javascript": "JavaScript", "python": "Python", "rust": "Rust", "go": "Go"}
