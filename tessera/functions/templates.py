"""Texts that generated documents, summaries and messages consist of, in order."""

from __future__ import annotations

DEFAULT_PROMPT = "你是一个资深架构师，请对以下代码进行详细的业务与功能归纳。"

# Summaries. Suffix of the class, text ({} stands for the name without it); the last is the default.
CLASS_SUMMARIES = [
    ("Controller", "本类为接口访问控制层控制器。定义了针对 {} 资源的相关 REST 路由接口，负责前端请求参数校验、数据分发和统一响应格式的封装输出。"),
    ("Service", "本类为系统的核心业务逻辑服务类。负责处理业务决策、状态机转换和数据处理的事务边界。协调各个数据操作的 Mapper 接口以提供完整的业务支持。"),
    ("Mapper", "本接口为 MyBatis 数据访问持久层接口。通过注解或 XML 配置底层的 SQL 语句，实现与数据库表的映射，为业务层提供原子级的数据查询与存取支持。"),
    ("", "本类为实体模型定义，映射数据库表字段或作为传输数据 DTO/VO，为业务流提供数据结构的骨架定义。"),
]
# Prefixes of the method, text; the last is the default.
METHOD_SUMMARIES = [
    (("get", "select", "list"), "该方法主要负责执行数据库只读检索逻辑。接收特定的过滤参数或标识符，通过持久层抓取对应记录并经过基础映射后输出至调用方。"),
    (("save", "create", "insert"), "该方法主要负责执行数据的写入逻辑。对传入实体进行参数完整性与格式化判定，随后通过数据源开启写入事务并在成功后返回对应的主键 ID。"),
    (("",), "该方法定义了特定的核心业务计算或协调流程。结合入参执行状态判断，并在关键节点写入操作流水日志，确保操作的幂等性与可追溯性。"),
]
# Fallback module by a part of the path, in order; the last is the default.
FALLBACK_MODULES = [
    (("controller",), "接口访问层 (Controller)"), (("service",), "业务逻辑层 (Service)"), (("mapper",), "数据访问层 (Mapper)"), (("entity", "dto"), "数据实体定义 (Entity)"), ((), "CoreModule"),
]
# Sections of a draft; {m} is the module, {classes} and the like are filled in.
DRAFT = """# {m} 知识归纳

## 一、 模块概述
本模块负责系统的 {m} 核心功能。通过对相关代码的静态解析和 AI 归纳，梳理其主要职责和调用流向。

## 二、 包含子模块
- 暂无子模块

## 三、 业务背景
本模块服务于 {m} 的基础业务场景，保证系统核心链路的数据正确性。

## 四、 业务目标
1. 提供高可靠性的业务处理逻辑。
2. 实现数据结构的完整性。

## 五、 功能描述
实现该模块对应的各种静态解析及动态事务管理。

## 六、 涉及类清单
{classes}
## 七、 输入数据
- 各种入参、VO 实体及 DTO 传输对象。

## 八、 输出接口 URL
{urls}
## 九、 输出数据
- 统一返回包装类 `ApiResponse`。

## 十、 核心业务流程图
```mermaid
graph TD
{flow}```

## 十一、 核心业务逻辑
{methods}## 十二、 调用链路说明
- 通过 Controller 接收前端 network 请求，交由 Service 模块执行核心逻辑，最终调用 Mapper 持久层写入数据库。

## 十三、 数据表与数据流
{tables}
## 十四、 规则、开关与配置
- 适用常规 JVM 及 Application.yml 通用配置项。

## 十五、 边界情况与异常处理清单
1. 参数非法时抛出 `BusinessException` 触发全局异常阻断。
2. 数据库连接异常超时自动重试失败。

## 十六、 待确认事项
- [ ] 接口响应的异常情况如何优雅透传前端？
- [ ] 数据库事务在并发场景下的锁机制是否符合业务并发限流标准？

## 十七、 代码来源依据
{sources}"""
NO_URLS, NO_TABLES, NO_FLOW = "- 暂无路由接口映射\n", "- 暂无关联数据表操作\n", "  Start --> Process --> End\n"
# Publication pages; {product} is a parameter.
MAIN_INDEX = """# {product}知识索引

本目录包含系统代码解析生成的完整架构和模块说明文档。

## 文档导览
- [架构概览](architecture-overview.md)
- [模块索引](module-index.md)
- [接口索引](api-index.md)
- [数据库索引](database-index.md)
- [依赖与调用链路](dependency-index.md)
- [待确认事项清单](pending-confirmation.md)
"""
MODULE_INDEX = "# 模块知识归纳索引\n\n本知识库由{product}基于大模型及静态解析自动归纳生成。\n\n## 系统模块列表\n"
DATABASE_INDEX = "# 数据库操作与表关联索引 (Database Index)\n\n| 涉及数据表 | 模块名称 | 操作方法 |\n| --- | --- | --- |\n"
DEPENDENCY_INDEX = "# 模块调用与类依赖链路 (Dependency Index)\n\n| 涉及类名 | 模块名称 | 依赖的其他类 |\n| --- | --- | --- |\n"
PENDING_INDEX = "# 待确认事项汇总清单\n\n"
NO_API, NO_ROWS, NO_PENDING = "| 暂无 | 暂无 | 暂无 | 暂无 |\n", "| 暂无 | 暂无 | 暂无 |\n", "恭喜，目前系统内无待确认的阻断事项！\n"
# Source checks in order.
SOURCE_ERRORS = ["请选择系统和代码库", "所选系统不存在", "所选系统已停用", "所选代码库不存在", "所选代码库不属于当前系统"]
# Status log lines.
LOG_DRAFT, LOG_RUNNING, LOG_RESULT, LOG_NO_SYSTEM, LOG_NO_REASON = "[next] 启动任务后将进入执行队列", "[worker] 执行管道运行中，进度正在刷新", "[result] Markdown 草稿已生成，可进入复核或版本推送", "正在加载系统元数据", "未知失败"
EMPTY_DRAFT = "# 空文档"
# Remark of a save without one, the default text of an empty item, and errors.
SAVED, UNNAMED_ITEM, NO_DRAFT, NO_ROW = "保存修改", "未命名待确认事项", "草稿不存在", "记录不存在"
VERSION_ERRORS = ["未找到反编译任务", "未找到关联的代码库配置", "草稿工作区不存在", "没有可导出的确认草稿"]
STAND_IN_COMMIT = "MOCK_PUSH_COMMIT_"
# Reason of a chunk marked as failed without one.
CHUNK_FAILED = "Chunk analysis failed"
# Further publication pages.
ARCHITECTURE = ("# 系统整体架构设计说明\n\n## 系统划分\n目前平台将代码仓库划分为 ", " 个主要业务模块：\n\n", "\n## 技术决策与原则\n1. 前后端分离设计\n2. 引入 Token 审计拦截与操作追踪日志\n")
FRONT_END = "# 前端子系统架构设计 (React)\n\n## 核心组件与库\n- 核心框架: React 18\n- 构建工具: Vite\n- 状态库: Zustand\n- 组件库: Ant Design 5\n"
BACK_END = "# 后端服务系统架构设计 (Java 17)\n\n## 核心框架\n- 基础框架: Spring Boot 3.x\n- 持久层: MyBatis-Plus / PostgreSQL\n- 缓存: Redis\n- 工作流: 任务状态机\n"
# Patterns and words of trial runs.
SAMPLE_CLASS, SAMPLE_METHOD = r"(?:public\s+)?(?:abstract\s+|final\s+)?(?:class|interface|enum)\s+(\w+)", r"(?:public|protected|private|static|final|synchronized|\s)+\s+[\w<>\[\],.?\s]+\s+(\w+)\s*\("
NOT_METHODS, NO_CLASS, NO_METHOD = ["if", "for", "while", "switch", "class", "synchronized", "catch"], "MockTestClass", "mockExecute"
# What a refused change of state says, before "A -> B".
REFUSED = "非法的状态流转: "
# Heads of the route index and of the module map.
API_INDEX, MODULE_MAP = "# 系统接口路由索引 (API Index)\n\n", "modules:\n"
# Log text of a change of state: before it, between the states, before the reason.
TRANSITION = ("任务状态变更: ", " -> ", "，原因: ")
