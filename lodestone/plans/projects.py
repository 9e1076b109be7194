"""Projects derived from customers, so that every rule of detection is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import project as p
from lodestone.plans.registry import query
from lodestone.session import load

_DEPS = ("express", "typescript", "react", "next", "vue", "nuxt", "fastify", "koa", "svelte", "@nestjs/core", "jsonwebtoken", "passport", "prisma", "knex", "jest", "cypress", "zod", "yup")
_FILES = ("tsconfig.json", "src/a.tsx", "setup.py", "go.mod", "pom.xml", "yarn.lock", "package-lock.json", "bun.lockb", "readme.md")
_DIRS = ("src/components", "services", "auth", "lib")
#: A name stands in a project if its place and the key agree.
_SQL = f"""
c AS (SELECT c_custkey AS k, c_custkey % 6 > 0 AS package,
  list_filter({list(_DEPS)}, lambda x, i: (c_custkey // (i % 5 + 1) + i) % 7 = 0 AND c_custkey % 6 > 0) AS deps,
  list_filter({list(_FILES)}, lambda x, i: (c_custkey // (i % 3 + 1) + i * 2) % 6 = 0) AS files,
  list_filter({list(_DIRS)}, lambda x, i: (c_custkey // i) % 2 = 0) AS dirs FROM customer),
d AS (SELECT *,
  CASE WHEN NOT package THEN CASE WHEN list_contains(dirs, 'src/components') THEN 'React Application' WHEN list_contains(dirs, 'services') THEN 'Backend API' ELSE 'Unknown Project' END
    WHEN list_contains(deps, 'express') THEN CASE WHEN list_contains(deps, 'typescript') THEN 'Express TypeScript API' ELSE 'Express.js API' END
    WHEN list_contains(deps, 'react') THEN CASE WHEN list_contains(deps, 'next') THEN 'Next.js Application' ELSE 'React Application' END
    WHEN list_contains(deps, 'vue') THEN CASE WHEN list_contains(deps, 'nuxt') THEN 'Nuxt.js Application' ELSE 'Vue.js Application' END
    WHEN list_contains(deps, 'fastify') THEN 'Fastify API' WHEN list_contains(deps, 'koa') THEN 'Koa.js API' WHEN list_contains(deps, '@nestjs/core') THEN 'NestJS Application'
    WHEN len(deps) > 0 THEN 'Node.js Project' ELSE 'Unknown Project' END AS type,
  CASE WHEN list_contains(files, 'tsconfig.json') OR list_contains(deps, 'typescript') OR list_contains(files, 'src/a.tsx') THEN 'TypeScript' WHEN list_contains(files, 'setup.py') THEN 'Python' WHEN list_contains(files, 'go.mod') THEN 'Go' WHEN list_contains(files, 'pom.xml') THEN 'Java' WHEN package THEN 'JavaScript' ELSE 'Unknown' END AS language,
  CASE WHEN NOT package THEN 'unknown' WHEN list_contains(deps, 'express') THEN 'Express.js' WHEN list_contains(deps, 'react') THEN 'React' WHEN list_contains(deps, 'vue') THEN 'Vue.js' WHEN list_contains(deps, 'svelte') THEN 'Svelte' WHEN list_contains(deps, 'fastify') THEN 'Fastify' WHEN list_contains(deps, 'koa') THEN 'Koa.js' WHEN list_contains(deps, '@nestjs/core') THEN 'NestJS' WHEN list_contains(deps, 'next') THEN 'Next.js' WHEN list_contains(deps, 'nuxt') THEN 'Nuxt.js' ELSE 'Node.js' END AS framework,
  CASE WHEN list_contains(files, 'yarn.lock') THEN 'Yarn' WHEN list_contains(files, 'package-lock.json') THEN 'NPM' WHEN list_contains(files, 'bun.lockb') THEN 'Bun' ELSE 'unknown' END AS manager,
  CASE WHEN package THEN list_filter([
    'auth=' || CASE WHEN list_contains(deps, 'jsonwebtoken') THEN 'JWT tokens' WHEN list_contains(deps, 'passport') THEN 'Passport.js' WHEN list_contains(dirs, 'auth') THEN 'Custom middleware' END,
    'database=' || CASE WHEN list_contains(deps, 'prisma') THEN 'Prisma ORM' WHEN list_contains(deps, 'knex') THEN 'Knex.js' END,
    'testing=' || CASE WHEN list_contains(deps, 'jest') THEN 'Jest' WHEN list_contains(deps, 'cypress') THEN 'Cypress' END,
    'validation=' || CASE WHEN list_contains(deps, 'zod') THEN 'Zod schemas' WHEN list_contains(deps, 'yup') THEN 'Yup schemas' END], lambda x: x IS NOT NULL) ELSE [] END AS patterns,
  least(1.0, CASE WHEN package THEN 0.3 ELSE 0 END + CASE WHEN package AND len(deps) > 0 THEN 0.2 ELSE 0 END + CASE WHEN package AND k % 4 > 0 THEN 0.1 ELSE 0 END + CASE WHEN list_contains(files, 'tsconfig.json') THEN 0.2 ELSE 0 END + CASE WHEN len(dirs) > 0 THEN 0.1 ELSE 0 END + CASE WHEN len(dirs) >= 3 THEN 0.1 ELSE 0 END) AS confidence FROM c),
h AS (SELECT *, 'PROJECT: ' || type || chr(10) || 'LANGUAGE: ' || language || CASE WHEN framework <> 'unknown' THEN chr(10) || 'FRAMEWORK: ' || framework ELSE '' END || CASE WHEN len(dirs) > 0 THEN chr(10) || 'STRUCTURE: ' || array_to_string(dirs, ', ') ELSE '' END || CASE WHEN len(deps) > 0 THEN chr(10) || 'LIBRARIES: ' || array_to_string(deps, ', ') ELSE '' END || CASE WHEN len(patterns) > 0 THEN chr(10) || 'PATTERNS: ' || array_to_string(patterns[1:2], ', ') ELSE '' END AS whole,
  'PROJECT: ' || type || CASE WHEN len(deps) > 0 THEN chr(10) || 'LIBRARIES: ' || array_to_string(deps[1:3], ', ') ELSE '' END AS small FROM d)
"""


@query(f"WITH {_SQL} SELECT k AS project, type, language, framework, manager, array_to_string(patterns, '; ') AS patterns, round(confidence, 6)::DOUBLE AS confidence, CASE WHEN type = 'Unknown Project' OR confidence < 0.5 THEN NULL WHEN ceil(length(whole) / 4.0) <= 30 THEN whole WHEN ceil(length(small) / 4.0) <= 30 THEN small END AS header, round(CASE WHEN type = 'Unknown Project' OR k % 9 = 0 THEN 0 ELSE 0.5 + CASE WHEN framework NOT IN ('unknown', 'Node.js') THEN 0.3 ELSE 0 END + CASE WHEN list_contains(files, 'src/a.tsx') THEN 0.1 ELSE 0 END + CASE WHEN list_contains(files, 'tsconfig.json') THEN 0.1 ELSE 0 END END, 6)::DOUBLE AS accuracy FROM h")
def project_context(spark, sf_dir):
    """SCALAR-38, SCALAR-39 (a header of up to thirty tokens), SCALAR-41."""
    k = F.col("k")
    pick = lambda names, hit: F.filter(F.array(*(F.lit(x) for x in names)), lambda x, i: hit(i + 1))
    whole = lambda a, b: F.floor(a / b)
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("package", k % 6 > 0)
    c = c.withColumns({
        "deps": pick(_DEPS, lambda i: ((whole(k, i % 5 + 1) + i) % 7 == 0) & (k % 6 > 0)),
        "files": pick(_FILES, lambda i: (whole(k, i % 3 + 1) + i * 2) % 6 == 0),
        "dirs": pick(_DIRS, lambda i: whole(k, i) % 2 == 0),
    })
    package, deps, files, dirs = (F.col(x) for x in ("package", "deps", "files", "dirs"))
    config = F.array_contains(files, "tsconfig.json")
    c = c.withColumns({
        "type": p.project_type(package, deps, dirs), "language": p.project_language(package, deps, files), "framework": p.project_framework(package, deps), "manager": p.package_manager(files),
        "patterns": p.project_patterns(package, deps, dirs), "confidence": p.project_confidence(package, F.size(deps), k % 4, config, dirs),
    })
    header = p.context_header(F.col("type"), F.col("language"), F.col("framework"), dirs, deps, F.col("patterns"), F.col("confidence"), 30)
    accuracy = p.context_accuracy(F.col("type") != "Unknown Project", k % 9, ~F.col("framework").isin("unknown", "Node.js"), F.array_contains(files, "src/a.tsx"), config)
    return c.select(k.alias("project"), "type", "language", "framework", "manager", F.array_join("patterns", "; ").alias("patterns"), F.round("confidence", 6).alias("confidence"), header.alias("header"), F.round(accuracy, 6).alias("accuracy"))
