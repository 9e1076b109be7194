"""What a project is, from the names of its dependencies, files and folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dependency -> kind or name, in order of precedence.
TYPES = (("vue", "Vue.js Application"), ("fastify", "Fastify API"), ("koa", "Koa.js API"), ("@nestjs/core", "NestJS Application"))
FRAMEWORKS = (("express", "Express.js"), ("react", "React"), ("vue", "Vue.js"), ("angular", "Angular"), ("svelte", "Svelte"), ("fastify", "Fastify"), ("koa", "Koa.js"), ("@nestjs/core", "NestJS"), ("next", "Next.js"), ("nuxt", "Nuxt.js"), ("gatsby", "Gatsby"), ("@remix-run/react", "Remix"))
MANAGERS = (("yarn.lock", "Yarn"), ("pnpm-lock.yaml", "PNPM"), ("package-lock.json", "NPM"), ("bun.lockb", "Bun"))
PATTERNS = {
    "auth": (("jsonwebtoken", "JWT tokens"), ("passport", "Passport.js"), ("@auth0/nextjs-auth0", "Auth0")),
    "database": (("prisma", "Prisma ORM"), ("mongoose", "Mongoose (MongoDB)"), ("typeorm", "TypeORM"), ("sequelize", "Sequelize"), ("knex", "Knex.js")),
    "testing": (("jest", "Jest"), ("mocha", "Mocha"), ("vitest", "Vitest"), ("cypress", "Cypress")),
    "validation": (("zod", "Zod schemas"), ("joi", "Joi validation"), ("yup", "Yup schemas")),
}
HEADER_TOKENS, LEAST_CONFIDENCE = 150, 0.5


def _first(names: Column, table, default: Column) -> Column:
    out = None
    for name, value in table:
        hit = F.array_contains(names, name)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def _any_holds(names: Column, *parts: str) -> Column:
    return F.exists(names, lambda d: F.greatest(*(F.contains(d, F.lit(p)) for p in parts)) if len(parts) > 1 else F.contains(d, F.lit(parts[0])))


def project_type(has_package: Column, deps: Column, dirs: Column) -> Column:
    has = lambda name: F.array_contains(deps, name)
    bare = F.when(_any_holds(dirs, "components"), "React Application").when(_any_holds(dirs, "services"), "Backend API").otherwise("Unknown Project")
    express = F.when(has("typescript") | has("@types/express"), "Express TypeScript API").otherwise("Express.js API")
    react = F.when(has("next"), "Next.js Application").when(has("@remix-run/react"), "Remix Application").otherwise("React Application")
    rest = _first(deps, TYPES, F.when(F.size(deps) > 0, "Node.js Project").otherwise("Unknown Project"))
    return F.when(~has_package, bare).when(has("express"), express).when(has("react"), react).when(has("vue") & has("nuxt"), "Nuxt.js Application").otherwise(rest)


def project_language(has_package: Column, deps: Column, files: Column) -> Column:
    holds = lambda *names: F.arrays_overlap(files, F.array(*(F.lit(n) for n in names)))
    script = F.array_contains(files, "tsconfig.json") | F.array_contains(deps, "typescript") | F.exists(files, lambda f: f.rlike(r"^src/[^/]*\.tsx?$"))
    out = F.when(script, "TypeScript").when(holds("requirements.txt", "pyproject.toml", "setup.py"), "Python").when(F.array_contains(files, "go.mod"), "Go")
    return out.when(holds("pom.xml", "build.gradle"), "Java").when(has_package, "JavaScript").otherwise("Unknown")


def project_framework(has_package: Column, deps: Column) -> Column:
    return F.when(~has_package, "unknown").otherwise(_first(deps, FRAMEWORKS, F.lit("Node.js")))


def package_manager(files: Column) -> Column:
    return _first(files, MANAGERS, F.lit("unknown"))


def project_patterns(has_package: Column, deps: Column, dirs: Column) -> Column:
    """kind=value pairs in order of kind; none without a package."""
    own = F.when(_any_holds(dirs, "middleware", "auth"), "Custom middleware")
    parts = [F.concat(F.lit(f"{kind}="), _first(deps, table, own if kind == "auth" else F.lit(None).cast("string"))) for kind, table in PATTERNS.items()]
    return F.when(has_package, F.array_compact(F.array(*parts))).otherwise(F.array().cast("array<string>"))


def project_confidence(has_package: Column, n_deps: Column, n_dev: Column, has_config: Column, dirs: Column) -> Column:
    """.3 package, .2 dependencies, .1 development ones, .2 configuration, .1 folders, .1 for three of them; at most 1."""
    one = lambda hit, n: F.when(hit, n).otherwise(0.0)
    raw = one(has_package, 0.3) + one(has_package & (n_deps > 0), 0.2) + one(has_package & (n_dev > 0), 0.1) + one(has_config, 0.2)
    return F.least(F.lit(1.0), raw + one(F.size(dirs) > 0, 0.1) + one(F.size(dirs) >= 3, 0.1))


def context_header(kind: Column, language: Column, framework: Column, dirs: Column, libraries: Column, patterns: Column, confidence: Column, most: int = HEADER_TOKENS) -> Column:
    """The header before a result: full if it fits ``most`` tokens (four characters each), else minimal, else null; null for an unknown project or low confidence."""
    line = lambda name, value, hit: F.when(hit, F.concat(F.lit(f"{name}: "), value))
    listed = lambda name, values: line(name, F.array_join(values, ", "), F.size(values) > 0)
    head = line("PROJECT", kind, F.lit(True))
    full = F.concat_ws("\n", head, line("LANGUAGE", language, language != "unknown"), line("FRAMEWORK", framework, (framework != "unknown") & (framework != language)), listed("STRUCTURE", dirs), listed("LIBRARIES", libraries), listed("PATTERNS", F.slice(patterns, 1, 2)))
    small = F.concat_ws("\n", head, listed("LIBRARIES", F.slice(libraries, 1, 3)))
    fits = lambda text: F.ceil(F.length(text) / 4) <= most
    unknown = (kind == "Unknown Project") | (confidence < LEAST_CONFIDENCE)
    return F.when(unknown, F.lit(None).cast("string")).when(fits(full), full).when(fits(small), small)


def context_accuracy(known: Column, n_chunks: Column, frameworks: Column, has_source: Column, has_config: Column) -> Column:
    """.5 + .3 for a framework + .1 for sources + .1 for configuration; 0 if the project is unknown or nothing was found."""
    one = lambda hit, n: F.when(hit, n).otherwise(0.0)
    return F.when(~known | (n_chunks == 0), 0.0).otherwise(F.least(F.lit(1.0), F.lit(0.5) + one(frameworks, 0.3) + one(has_source, 0.1) + one(has_config, 0.1)))
